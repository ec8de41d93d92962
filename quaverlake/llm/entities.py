"""Variant spellings of names typed by people: merge-and-rematch resolution.

Stored values are parsed (``names.py``); values with the same words are one *form*. Every form
begins as an entity. Forms of two words match if both are the same, or one of them and the other short of a
typing error, where a nickname also stands for its full name; longer forms if all words but one are the same;
any two if their words run together are. What matches is closed to components and merged. A merged entity's
profile is the union of its forms: pairs of a given name of one and a surname of another, which no single
spelling had, enter blocking again, until no further merge occurs. Songs go the same way within an
artist: titles that match are merged, and titles made of the merged ones' spellings of each word enter
again.

Relatives share a surname, and groups a word: two words that are both frequent in the collection
are never taken for misspellings of each other. An initial, or a nickname of several names,
says too little to link by itself: it joins the only entity that it can mean, or none.

Blocks hold distinct spellings, each once, with the least and the greatest entity that has it. As all
spellings of a block are one letter away from its key, a block is small however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.common import components, one_row_per_key, with_dense_id
from quaverlake.llm.names import NICKNAMES, deletions, one_edit, parse_name, parse_title
from quaverlake.session import cut, stored

_FORMS_SQL = "value string, n long, form string, words array<string>, initials array<string>, squashed string"
_FACTS_SQL = "form long, kind string, a string, b string"
_EDGES_SQL = "a long, b long"
#: A word is frequent if this share of forms (but at least 3) has it. So at most a few thousand are.
FREQUENT = 1 / 2000
#: Two shorter words are compared exactly, and so are words that stand alone and titles if shorter than twice that.
TYPO_LENGTH = 4


def _schema(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


_TEXT, _LONG = pa.string(), pa.int64()
_FORMS = _schema(("value", _TEXT), ("n", _LONG), ("form", _TEXT), ("words", pa.list_(_TEXT)), ("initials", pa.list_(_TEXT)), ("squashed", _TEXT))
_FACTS = _schema(("form", _LONG), ("kind", _TEXT), ("a", _TEXT), ("b", _TEXT))
_EDGES = _schema(("a", _LONG), ("b", _LONG))


def _arrow(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[i : i + 65536], strict=True), schema, strict=True)], schema=schema)


def _parse(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        rows = []
        for value, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, initials, squashed = parse_name(value)
            if not words and not initials:
                continue
            words = sorted(words)
            alone = len(words) < 2
            form = " ".join(words) + ("|" + "".join(sorted(initials)) if alone and initials else "")
            rows.append((value, n, form, words, sorted(initials) if alone else [], "" if alone and initials else squashed))
        yield from _arrow(rows, _FORMS)


class _Facts:
    """What a form says: ``s`` its words run together; ``p`` two words that it may stand for, and ``c`` those of
    them of which the first alone is frequent; ``k`` one of several words beside the others; or, of a weak form, ``w``
    an initial or ``n`` a full name that a nickname may stand for, beside a surname, and ``q`` the two words as they are."""

    def __init__(self, frequent: frozenset[str], nicknames: Mapping[str, str]):
        self.frequent, self.nicknames = frequent, {k: v.split() for k, v in nicknames.items()}
        self.near: dict[str, list[str]] = {}
        for g in frequent:
            if len(g) >= TYPO_LENGTH:
                for v in deletions(g):
                    self.near.setdefault(v, []).append(g)

    def full_names(self, word: str) -> list[str]:
        names = self.nicknames.get(word, [])
        return [f for f in names if f in self.frequent] or names if len(names) > 1 else names

    def _pairs(self, a: str, b: str) -> list[tuple[str, str]]:
        """Nicknames in full, and where neither word is frequent, a frequent word one edit away."""
        pairs = {(a, b)}
        for x, y in ((a, b), (b, a)):
            names = self.full_names(x)
            if len(names) == 1:
                pairs.add((names[0], y))
            if a not in self.frequent and b not in self.frequent and len(x) >= TYPO_LENGTH:
                pairs |= {(g, y) for v in deletions(x) for g in self.near.get(v, ()) if one_edit(g, x)}
        return sorted({tuple(sorted(p)) for p in pairs})

    def of(self, words: list[str], initials: list[str], squashed: list[str]) -> Iterator[tuple[str, str, str]]:
        if len(words) == 1 and initials:
            yield from (("w", i, words[0]) for i in initials)
            return
        if len(words) == 2:
            nick = next(((x, y) for x, y in (words, words[::-1]) if len(self.full_names(x)) > 1), None)
            if nick:
                yield "q", *words
                yield from (("n", name, nick[1]) for name in self.full_names(nick[0]))
                return
            for a, b in self._pairs(*words):
                yield "p", a, b
                yield from (("c", x, y) for x, y in ((a, b), (b, a)) if x in self.frequent and y not in self.frequent)
        elif len(words) > 2:
            yield from (("k", " ".join(words[:i] + words[i + 1 :]), word) for i, word in enumerate(words))
        elif words and len(words[0]) >= 2 * TYPO_LENGTH:
            yield "k", "", words[0]
        yield from (("s", s, "") for s in squashed if s)

    def __call__(self, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[tuple] = []
            for form, *own in zip(*[batch.column(c).to_pylist() for c in ("id", "words", "initials", "squashed")], strict=True):
                rows += dict.fromkeys((form, *fact) for fact in self.of(*own))
            yield from _arrow(rows, _FACTS)


def _misspelt(a: str, b: str, frequent: frozenset[str]) -> bool:
    """Whether the words can be spellings of one; not if both are frequent in the collection or hold
    digits. How often a spelling is used says nothing: a misspelt one may be used again and again."""
    if a == b:
        return True
    if a in frequent and b in frequent or any(c.isdigit() for c in a + b):
        return False
    return one_edit(a, b)


def _variants(word: Column | str) -> Column:
    """The word and what is left of it without one of its letters."""
    word = F.col(word) if isinstance(word, str) else word
    cuts = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cuts))


def _short_of_one(rows: DataFrame) -> DataFrame:
    """Rows with v, p itself and, if it has TYPO_LENGTH letters at least, each spelling of it short of one letter."""
    variants = F.when(F.length("p") >= TYPO_LENGTH, _variants("p")).otherwise(F.array("p"))
    return rows.select("*", F.explode(variants).alias("v"))


def _links(same):
    """Blocks of (spelling, node): an edge for every two whose spellings may be the same."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = set()
            for block in batch.column("block").to_pylist():
                for i, x in enumerate(block):
                    rows |= {(x["node"], y["node"]) for y in block[i + 1 :] if x["node"] != y["node"] and same(x["p"], y["p"])}
            yield from _arrow(sorted(rows), _EDGES)

    return run


def _within_blocks(distinct: DataFrame, keys: list[str], same) -> DataFrame:
    """Edges between the nodes of different spellings p in each block; p stands once in a block."""
    blocks = distinct.groupBy(*keys).agg(F.collect_list(F.struct("p", "node")).alias("block")).where(F.size("block") > 1)
    return blocks.select("block").mapInArrow(_links(same), _EDGES_SQL)


def _starred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An edge from every node of equal keys to the least of them."""
    least = rows.groupBy(*keys).agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    return rows.join(least.select(*keys, "least"), keys).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))


def _fitting(frequent: frozenset[str]):
    """Of rows (p, q, ...) those whose words may be spellings of one."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keep = [_misspelt(p, q, frequent) for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _frequent(words: DataFrame, forms: int) -> frozenset[str]:
    least = max(3, int(forms * FREQUENT))
    return frozenset(r.w for r in words.groupBy("w").count().where(F.col("count") >= least).collect())


def _merged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (form, entity) with the entities that ``edges`` link made one."""
    groups = components(edges)
    joined = nodes.join(groups.withColumnRenamed("node", "entity"), "entity", "left")
    return stored(joined.select("form", F.coalesce("component", "entity").alias("entity")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("node", F.col("a").alias("c"), F.col("b").alias("p")).unionByName(pairs.where("a <> b").select("node", F.col("b").alias("c"), F.col("a").alias("p")))


def resolve_names(df: DataFrame, name: str, nicknames: Mapping[str, str] = NICKNAMES) -> DataFrame:
    """(value, entity): every distinct value of ``name`` that names somebody, compared exactly, with
    a number of the entity it names. Null, blank and placeholder values (``Various Artists`` and the
    like) aren't in it. The numbers are the same for a retry, not for other input. Repeated rows
    count once; other columns aren't read; an empty table gives no rows.

    ``nicknames``: short forms, and the full names that each may stand for, with spaces between. Ends with the round
    that merges nothing; each merges entities, so there is an end. The driver holds the frequent words, at most
    (words a form) / FREQUENT of them. A typing error is one letter more, less, another, or two neighbours
    exchanged, in a word of TYPO_LENGTH letters or more (a single word: twice that)."""
    values = df.select(F.col(name).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    parsed = stored(values.mapInArrow(_parse, _FORMS_SQL))
    grouped = parsed.groupBy("form").agg(F.max("words").alias("words"), F.max("initials").alias("initials"), F.collect_set("squashed").alias("squashed"))
    forms = stored(with_dense_id(cut(grouped), "id"))
    frequent = _frequent(forms.select(F.explode("words").alias("w")), forms.count())
    facts = stored(forms.mapInArrow(_Facts(frequent, nicknames), _FACTS_SQL))
    of = lambda *kinds: facts.where(F.col("kind").isin(list(kinds))).select(F.col("form").alias("node"), "a", "b")

    # what forms say by themselves
    pairs = of("p")
    sides = _both_ways(pairs).withColumn("c", F.concat(F.lit("2|"), "c")).unionByName(of("k").select("node", F.concat(F.lit("k|"), "a").alias("c"), F.col("b").alias("p")))
    # a node stands for all that share its spelling
    sides = sides.groupBy("c", "p").agg(F.min("node").alias("node"))
    near = _within_blocks(_short_of_one(sides), ["c", "v"], lambda p, q: _misspelt(p, q, frequent))
    links = _starred(of("p", "q"), ["a", "b"]).unionByName(_starred(of("s"), ["a"])).unionByName(near)
    nodes = _merged(forms.select(F.col("id").alias("form"), F.col("id").alias("entity")), stored(links))

    # merged profiles enter again
    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(nodes.withColumnRenamed("form", "node"), "node").select("entity", *[c for c in rows.columns if c != "node"])

    while True:
        held = placed(of("c")).distinct()
        several = held.groupBy("entity").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).where("a0 < a1 AND b0 < b1").select("entity")
        own = held.join(several, "entity", "left_semi")
        crossed = own.select("entity", "a").distinct().join(own.select("entity", "b").distinct(), "entity").where("a <> b")
        found = crossed.select("entity", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = stored(found.join(placed(pairs).distinct(), ["entity", "a", "b"], "left_anti"))
        # a profile's pair has the place of its entity's first form
        first = nodes.groupBy("entity").agg(F.min("form").alias("node"))
        mine = fresh.join(first, "entity").select("node", "a", "b")
        every = pairs.unionByName(mine)
        exact = mine.withColumnRenamed("node", "x").join(every.withColumnRenamed("node", "y"), ["a", "b"]).select("x", "y")
        asked = _both_ways(mine).withColumnRenamed("node", "x")
        sides = _short_of_one(asked)
        # few words are asked for, so most pairs are left out before they are spelt short of a letter
        others = _short_of_one(_both_ways(every).select(F.col("node").alias("y"), "c", "p").join(asked.select("c").distinct(), "c", "left_semi")).withColumnRenamed("p", "q")
        typed = sides.join(others, ["c", "v"]).where("p <> q AND x <> y").select("p", "q", "x", "y").distinct().mapInArrow(_fitting(frequent), "p string, q string, x long, y long").select("x", "y")
        at = lambda c: nodes.select(F.col("form").alias(c), F.col("entity").alias(f"e{c}"))
        merges = stored(exact.unionByName(typed).join(at("x"), "x").join(at("y"), "y").where("ex <> ey").select(F.col("ex").alias("a"), F.col("ey").alias("b")).distinct())
        if merges.isEmpty():
            break
        nodes = _merged(nodes, merges)

    # initials and nicknames of several names join the only entity that they can mean
    strong = placed(of("p", "k", "s")).select("entity").distinct()
    weak = placed(facts.where("kind IN ('w', 'n')").select(F.col("form").alias("node"), "kind", F.col("a").alias("c"), F.col("b").alias("p"))).join(strong, "entity", "left_anti").withColumnRenamed("entity", "weak").distinct()
    weak = stored(weak)
    known = placed(_both_ways(pairs.unionByName(mine)))
    heads = known.withColumn("kind", F.lit("n")).unionByName(known.select("entity", F.substring("c", 1, 1).alias("c"), "p", F.lit("w").alias("kind")))
    heads = stored(heads.groupBy("kind", "c", "p").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")))
    same = weak.join(heads, ["kind", "c", "p"]).select("weak", F.lit(1).alias("level"), "lo", "hi")
    meant = heads.join(weak.select("kind", "c").distinct(), ["kind", "c"], "left_semi")
    typed = _short_of_one(weak).join(_short_of_one(meant).withColumnRenamed("p", "q"), ["kind", "c", "v"]).where("p <> q").select("p", "q", "weak", "lo", "hi").distinct()
    typed = typed.mapInArrow(_fitting(frequent), "p string, q string, weak long, lo long, hi long").select("weak", F.lit(2).alias("level"), "lo", "hi")
    fits = same.unionByName(typed).groupBy("weak").agg(F.min("level").alias("best"), *[f(F.when(F.col("level") == n, F.col(c))).alias(f"{c}{n}") for n in (1, 2) for f, c in ((F.min, "lo"), (F.max, "hi"))])
    joins = fits.where("if(best = 1, lo1 = hi1, lo2 = hi2)").select(F.col("weak").alias("a"), F.expr("if(best = 1, lo1, lo2)").alias("b"))
    nodes = _merged(nodes, stored(joins))
    return parsed.select("value", "form").join(forms.select("form", F.col("id")), "form").select("value", F.col("id").alias("form")).join(nodes, "form").select("value", "entity")


_SONGS = _schema(("item", _TEXT), ("entity", _LONG), ("version", _TEXT), ("squashed", _TEXT), ("words", pa.list_(_TEXT)))


def _titles(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        rows = []
        for item, entity, title in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            words, version = parse_title(title)
            if words:
                rows.append((item, entity, version, "".join(words), words))
        yield from _arrow(rows, _SONGS)


def _same_title(a: str, b: str, frequent: frozenset[str]) -> bool:
    """Titles as words with spaces between: one edit apart when run together, and not in a word that both are frequent in."""
    x, y = a.split(" "), b.split(" ")
    if not one_edit("".join(x), "".join(y)):
        return False
    odd = [(v, w) for v, w in zip(x, y, strict=False) if v != w]
    if len(x) == len(y) and len(odd) == 1:
        return _misspelt(*odd[0], frequent)
    return not any(c.isdigit() for v, w in odd for c in v + w)


def resolve_songs(items: DataFrame, names: DataFrame, key: str, name: str, title: str) -> DataFrame:
    """(item, song): every non-null ``key`` whose ``name`` has an entity in ``names`` and whose title
    isn't null or blank, with a number of its song: same entity, same version, and titles that are
    equal but for case, accents, spacing, signs, notes on an edition, and one typing error, or that are
    made of words as merged titles spell them. A title of less than twice TYPO_LENGTH letters is compared
    exactly. Repeated rows of a key count once (if they differ, the largest)."""
    once = one_row_per_key(items.select(F.col(key).cast("string").alias("item"), F.col(name).alias("name"), F.col(title).alias("title")), "item", "name", "title").where("name IS NOT NULL AND title IS NOT NULL")
    placed = once.join(names.withColumnRenamed("value", "name"), "name").select("item", "entity", "title")
    songs = stored(placed.mapInArrow(_titles, "item string, entity long, version string, squashed string, words array<string>"))
    distinct = songs.groupBy("entity", "version", "squashed").agg(F.max("words").alias("words"))
    titles = stored(with_dense_id(cut(distinct.withColumnRenamed("entity", "owner")), "form"))
    frequent = _frequent(titles.select(F.explode(F.array_distinct("words")).alias("w")), titles.count())
    long = titles.where(F.length("squashed") >= 2 * TYPO_LENGTH)
    blocks = long.select("owner", "version", F.explode(_variants("squashed")).alias("v"), F.array_join("words", " ").alias("p"), F.col("form").alias("node"))
    links = stored(_within_blocks(blocks, ["owner", "version", "v"], lambda p, q: _same_title(p, q, frequent)))
    nodes = _merged(titles.select("form", F.col("form").alias("entity")), links)
    while True:
        # two words at a time as the merged titles spell them; each alone is a title already
        several = nodes.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
        held = titles.join(nodes.join(several, "entity", "left_semi"), "form")
        spelt = held.select("entity", "owner", "version", F.size("words").alias("length"), F.posexplode("words").alias("i", "w")).distinct()
        base = held.groupBy("entity", "owner", "version", F.size("words").alias("length")).agg(F.min_by("words", "form").alias("words"))
        one = base.join(spelt, ["entity", "owner", "version", "length"]).where(F.element_at("words", F.col("i") + 1) != F.col("w"))
        swap = lambda words, i, w: F.concat(F.slice(words, F.lit(1), i), F.array(w), F.slice(words, i + 2, F.size(words)))
        two = one.join(one.select("entity", "length", F.col("i").alias("j"), F.col("w").alias("x")), ["entity", "length"]).where("i < j")
        made = two.select("entity", "owner", "version", F.array_join(swap(swap(F.col("words"), F.col("i"), F.col("w")), F.col("j"), F.col("x")), "").alias("squashed")).distinct()
        met = made.join(titles.join(nodes.withColumnRenamed("entity", "other"), "form").select("owner", "version", "squashed", "other"), ["owner", "version", "squashed"])
        merges = stored(met.where("entity <> other").select(F.col("entity").alias("a"), F.col("other").alias("b")).distinct())
        if merges.isEmpty():
            break
        nodes = _merged(nodes, merges)
    labels = titles.join(nodes, "form").select(F.col("owner").alias("entity"), "version", "squashed", F.col("entity").alias("song"))
    return songs.select("item", "entity", "version", "squashed").join(labels, ["entity", "version", "squashed"]).select("item", "song")


def entity_classes(items: DataFrame, key: str = "item_id", name: str = "artist", title: str = "title", nicknames: Mapping[str, str] = NICKNAMES) -> DataFrame:
    """(kind, key, class_id, members): every stored spelling of an artist (kind ``artist``) and every key of a song
    (``song``) with the least of its class in byte order, and the number of all in it. A row each, however
    large a class is. Cases as in ``resolve_names`` and ``resolve_songs``."""
    names = stored(resolve_names(items, name, nicknames))
    songs = stored(resolve_songs(items, names, key, name, title))
    rows = names.select(F.lit("artist").alias("kind"), F.col("value").alias("key"), F.col("entity").alias("class")).unionByName(songs.select(F.lit("song").alias("kind"), F.col("item").alias("key"), F.col("song").alias("class")))
    sizes = rows.groupBy("kind", "class").agg(F.min("key").alias("class_id"), F.count("*").alias("members"))
    return rows.join(sizes, ["kind", "class"]).select("kind", "key", "class_id", "members")


def same_entities(items: DataFrame, key: str = "item_id", name: str = "artist", title: str = "title", nicknames: Mapping[str, str] = NICKNAMES) -> DataFrame:
    """(kind, key_a, key_b), key_a < key_b in byte order: the view of ``entity_classes`` by pairs: ``artist`` for two
    stored spellings of one name, ``song`` for two keys of one song by one artist."""
    some = stored(entity_classes(items, key, name, title, nicknames).where("members > 1"))
    a, b = some.select("kind", "class_id", F.col("key").alias("key_a")), some.select("kind", "class_id", F.col("key").alias("key_b"))
    return a.join(b, ["kind", "class_id"]).where("key_a < key_b").select("kind", "key_a", "key_b")
