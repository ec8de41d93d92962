"""Parsing of names and titles typed by people, as plain Python functions of strings."""

from __future__ import annotations

import re
import unicodedata

# Letters that decomposition leaves as they are.
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "’": "'", "‘": "'", "‐": "-", "‑": "-", "–": "-", "—": "-"})

# Placeholders that name nobody.
PLACEHOLDERS = frozenset({"various artists", "various artist", "various", "va", "unknown artist", "unknown", "n/a", "na", "none", "null", "no artist", "untitled artist", "-", "?"})

# Short forms of English given names, and the names they may stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alfred", "alex": "alexander alexandra", "andy": "andrew andreas", "angie": "angela", "annie": "anne anna anneke", "art": "arthur arturo", "babs": "barbara",
    "barb": "barbara", "bart": "bartholomew", "bas": "sebastian", "bea": "beatrice", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "bernie": "bernard", "bert": "albert robert", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth",
    "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "carrie": "caroline", "cat": "catherine katharine", "cathy": "catherine katharine", "charlie": "charles charlotte", "chris": "christopher christine", "chuck": "charles",
    "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "dolly": "dorothy", "dom": "dominic", "don": "donald", "dora": "dorothy theodora", "dot": "dorothy", "ed": "edward edwin", "eddie": "edward", "ellie": "eleanor", "ernie": "ernest", "flo": "florence", "flossie": "florence",
    "fran": "francesca frances", "frank": "francis franklin", "frankie": "francesca francis", "fritz": "frederick", "fred": "frederick alfred", "freddie": "frederick", "gabe": "gabriel", "gabby": "gabriel", "gene": "eugene", "gerry": "gerald", "ginny": "virginia genevieve", "greg": "gregory", "gus": "gustav augustus",
    "hal": "harold henry", "hank": "henry", "harry": "harold henry", "izzy": "isabella", "jack": "john", "jake": "jacob", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jeremy", "jim": "james", "jimmy": "james", "jo": "joanna josephine", "joe": "joseph", "jon": "jonathan", "josie": "josephine", "judy": "judith", "jules": "julian",
    "kat": "katharine catherine", "kate": "katharine catherine", "katie": "katharine catherine", "kathy": "katharine catherine", "ken": "kenneth", "kenny": "kenneth", "kit": "christopher", "kitty": "katharine catherine", "larry": "laurence lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "lettie": "leticia", "lil": "lillian", "lily": "lillian", "liz": "elizabeth", "lizzie": "elizabeth",
    "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "marty": "martin", "matt": "matthew", "max": "maximilian", "meg": "margaret", "mick": "michael", "mike": "michael", "mimi": "miriam", "molly": "mary", "nat": "nathaniel", "nate": "nathaniel", "ned": "edward", "nell": "eleanor helen", "nick": "nicholas", "nicky": "nicholas",
    "ollie": "oliver", "ozzie": "oscar", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "paula": "paulina", "peggy": "margaret", "pete": "peter", "phil": "philip", "pip": "philippa", "raf": "rafael", "ray": "raymond", "rich": "richard", "richie": "richard", "rick": "richard", "ricky": "richard", "rob": "robert", "robbie": "robert", "ron": "ronald", "rosie": "rosalind", "roz": "rosalind",
    "sally": "sarah", "sam": "samuel samantha", "sammy": "samuel", "sasha": "alexander alexandra", "sandy": "sandra alexander", "seb": "sebastian", "sophie": "sofia", "steve": "stephen steven", "stevie": "stephen steven", "sue": "susan susanna", "susie": "susanna", "tammy": "tamara", "ted": "theodore edward", "terry": "terence theresa", "tess": "theresa", "theo": "theodore", "tilly": "matilda", "tim": "timothy", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "tory": "victoria", "trish": "patricia",
    "val": "valentina valerie", "vic": "victor", "vicky": "victoria", "vince": "vincent", "vinnie": "vincent", "viv": "vivian", "wally": "walter", "walt": "walter", "will": "william", "xander": "alexander",
}

# Abbreviations of words in the names of groups.
SHORT_WORDS = {
    "bros": "brothers", "sis": "sisters", "co": "company", "coll": "collective", "dept": "department", "ens": "ensemble", "orch": "orchestra", "phil": "philharmonic", "proj": "project", "sinf": "sinfonia", "soc": "society", "assn": "association", "qt": "quartet", "symph": "symphony", "un": "union", "3o": "trio", "4tet": "quartet",
}

# Words of notes that don't make another song, and of those that do.
EDITION = frozenset("remaster remastered remastering edition deluxe mono stereo reissue anniversary expanded bonus explicit clean original album digital".split())
VERSION = frozenset("live acoustic remix mix instrumental demo unplugged karaoke cover rehearsal session sessions edit dub reprise medley a cappella acapella orchestral piano extended".split())

_PART = re.compile(r"(?:,\s*|\s+|\s*[(\[]\s*)(pt|part|no|nr|vol|volume|number|chapter)\s*\.?\s*(\d+|[ivx]+)\b\s*[)\]]?\s*$", re.I)
_TAIL = re.compile(r"\s*(?:[(\[]([^()\[\]]*)[)\]]|\s-\s+([^()\[\]-]+))\s*$")
_PART_NAME = {"part": "pt", "number": "no", "nr": "no", "volume": "vol"}


def fold(text: str) -> str:
    """Without accents and other marks, case kept."""
    text = unicodedata.normalize("NFKD", text.translate(LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(LETTERS)


def _spread(text: str) -> str:
    """Words of a string without white space: at hyphens, underscores, signs and inner capitals."""
    text = re.sub(r"[-_]", " ", text)
    text = re.sub(r"([&+])", r" \1 ", text)
    text = re.sub(r"\.(?=\w)", ". ", text)
    # "Xthe Y" written together: "&theKinno", "TheCompassofFeather"
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    return re.sub(r"(?<=& )the(?=[A-Z])", "the ", text)


def parse_name(value: str) -> tuple[list[str], list[str], str]:
    """(words, initials, squashed) of a name: words of two letters or more in their given order,
    surname after given name, without articles; single letters; and all words and ampersands in one
    string. Nothing in it if the value is blank or a placeholder."""
    text = fold(value).strip()
    if not text or text.casefold().strip("[](){}<>* .").strip() in PLACEHOLDERS or text.casefold() in PLACEHOLDERS:
        return [], [], ""
    text = re.sub(r"\(\s*the\s*\)", " ", text, flags=re.I).strip()
    if not re.search(r"\s", text):
        text = _spread(text)
    text = text.casefold().replace("_", " ").replace("-", "")
    head, comma, tail = text.partition(",")
    if comma and "," not in tail:
        text = head if tail.strip() in ("the", "") else f"{tail} {head}"
    text = re.sub(r"\s(?:and|n')\s|\s*[&+]\s*", " & ", text)
    words, initials, squashed = [], [], []
    for raw in text.split():
        if raw == "&":
            squashed.append("&")
            continue
        word = re.sub(r"[^\w]", "", raw)
        if word in ("", "the"):
            continue
        if len(word) == 1 and not word.isdigit():
            initials.append(word)
            continue
        word = SHORT_WORDS.get(word, word) if raw.endswith(".") else word
        words.append(word)
        squashed.append(word)
    # written without a full stop they are told from names by standing last
    if len(words) > 1 and squashed[-1] == words[-1] in SHORT_WORDS:
        squashed[-1] = words[-1] = SHORT_WORDS[words[-1]]
    if not words and not initials:
        return [text], [], text
    return words, initials, "".join(squashed)


def parse_title(value: str) -> tuple[list[str], str]:
    """(words, version) of a title: notes on a remaster or an edition are dropped; what makes another
    recording or number (live, acoustic, remix, part 2) is the version. No words: a blank title."""
    text = fold(value).strip()
    if not text:
        return [], ""
    version: list[str] = []
    if not re.search(r"\s", text):
        text = _spread(text)
    elif "_" in text or not re.search(r"\s", text.replace(" - ", "")):
        text = text.replace("_", " ")
    text = text.rstrip("!.?… ").strip() or text
    while True:
        if m := _PART.search(text):
            kind = m.group(1).casefold()
            version.append(_PART_NAME.get(kind, kind) + m.group(2).casefold())
        elif (m := _TAIL.search(text)) and m.start() > 0:
            note = re.findall(r"\w+", (m.group(1) if m.group(1) is not None else m.group(2)).casefold())
            marks = [w for w in note if w in VERSION]
            if marks and not (marks == ["mix"] and "mono" in note):
                version.append(" ".join(note))
            elif not (set(note) & EDITION or note[:1] in (["feat"], ["ft"], ["featuring"], ["with"]) or not note):
                if all(w.isdigit() and len(w) == 4 for w in note) or "version" in note:
                    pass
                else:
                    version.append(" ".join(note))
        else:
            break
        text = text[: m.start()].rstrip(" ,-")
    text = text.casefold().replace("'", "").replace("-", " ")
    text = re.sub(r",\s*the\s*$", "", text)
    text = re.sub(r"\s*[&+]\s*|\sn\s", " and ", text)
    words = re.findall(r"\w+", text)
    # articles come and go within a title, as in names
    words = [{"2": "two", "4": "for", "o": "of", "n": "and"}.get(w, w) for w in words if w != "the"]
    return (words or [text.strip()]), "+".join(sorted(version))


def deletions(word: str) -> set[str]:
    """The word and what is left of it without one of its letters."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def one_edit(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced, or exchanged with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]
