"""Personal information inside free text (problem 9): a skip-chain conditional random field.

Tokens of a text form a chain; repeated tokens that can be names are tied by skip edges, so that an occurrence in plain
surroundings takes its label from one in telling surroundings.  Potentials are fitted piecewise: unary weights by
logistic regression over hashed features of a token and its neighbours (identity, shape, dictionaries of given and
family names, titles and roles), transitions by label counts, and the skip weight by what it does to texts in which
names not seen before occur a second time in plain surroundings.  Inference passes messages along the chains and the
skip edges in turn (loopy), then takes the best path.

Labelled rows are made by general cues (titles, roles, field labels, neighbouring contact details, the shapes of
addresses and numbers) and by the names these lead to, on a bounded sample of documents (`SAMPLE_DOCS` of at most
`SAMPLE_CHARS` characters); the model is trained in the query and applied to every text as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import spread
from . import flat

SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 4_000
BUCKETS = 1 << 16
TYPES = ("person_name", "email", "phone", "id_number", "street_address")
LABELS = 1 + 2 * len(TYPES)  # 0 outside; 1 + 2k begins, 2 + 2k goes on with type k
REACH = 3
#: A token whose best label is this far (in log odds) from "outside" or nearer is looked at in its chain; the rest is outside.
#: Measured on 10,000 documents: without the gate, 3 of 5,918 pieces more come out (none of them right), in eleven times the time.
GATE = 4.0
ROUNDS = 2

# ---------------------------------------------------------------------------------------------------------------
# Labelling cues.  _D is a digit of either script, _L a Latin capital, _A an Arabic letter or mark.

_D = r"[0-9٠-٩]"
_L = r"A-ZÀ-ÖØ-Þ"
_A = "[ء-غف-يـً-ْ]"
# Common given names of several languages that are no common words.
GIVEN = frozenset(
    "adam ahmed aisha alan albert alberto alejandro alexander alexandra ali alice amanda amina amir ana andrea andreas andrew angela anita anna anne antonio arthur barbara benjamin bernard brian carla carlos carmen caroline catherine "
    "charles christine christopher claire claudia daniel david deborah diana diego dimitri dmitri donald dorothy edward elena elizabeth emily emma eric eva fatima fernando francesca francisco françois frank george giovanni gustav hana hannah "
    "hans hassan helen henry hiroshi hussein ibrahim igor ines ingrid irina isabel ivan jacques james jane javier jean jennifer john jorge josé joseph joshua juan julia karen karim katarina kenneth khalid laura layla leila linda louis lucia "
    "lucy luis maria mariam marie mario martha martin mary mehmet michael michel miguel mohamed mohammed monica mustafa nadia natalia nicolas nina noura olga oliver omar pablo patricia patrick paul pedro peter philip pierre rachel rania "
    "rebecca ricardo richard robert roberto rosa ruth samira samuel sandra sara sarah sergei simon sofia sophie stefan stephen susan svetlana tariq teresa thomas tomas ursula vera victor victoria vladimir walter wei william yasmin yousef yuki zainab".split()
)
# The same in Arabic.
GIVEN_AR = frozenset("أحمد محمد محمود علي حسن حسين خالد عمر يوسف إبراهيم مصطفى كريم سمير طارق ياسر وليد هشام رامي زياد بلال فاطمة عائشة مريم ليلى نورا نور هدى سلمى رنا دينا ياسمين زينب سعاد سوسن نادية ميادة سميرة منى هند خديجة".split())
# Titles before a name, roles and labels that announce one, and what follows a family name in Arabic or stands in a name's place.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Judge|Ambassador|Sir|Dame|Madam|Captain|Colonel|Sergeant|Reverend|Sheikh|Monsieur|Madame|Mme|Mlle"
ROLES = (
    "accountant|administrator|adviser|advisor|analyst|applicant|architect|assistant|attorney|author|caretaker|chair|chairman|chairperson|chairwoman|claimant|cleaner|clerk|colleague|complainant|consultant|contact|cook|coordinator|counsel|daughter|"
    "defendant|deputy|director|doctor|driver|editor|engineer|father|focal point|guard|husband|inspector|interpreter|landlord|lawyer|librarian|manager|mother|neighbour|neighbor|nurse|officer|owner|patient|physician|president|rapporteur|"
    "representative|researcher|resident|respondent|secretary|sister|brother|son|spokesman|spokesperson|spokeswoman|student|supervisor|surveyor|teacher|tenant|translator|treasurer|victim|widow|wife|witness"
)
TITLES_AR = "سيد|سيدة|آنسة|دكتور|دكتورة|أستاذ|أستاذة|مهندس|مهندسة|قاضي|قاضية|سفير|سفيرة|شيخ"
ROLES_AR = "الشاهدة?|المحامية?|المقررة?|الاسم|صاحب الطلب|مقدم الطلب|جهة الاتصال|رقم هوية|السائق|المحاسبة?|المديرة?|الطبيبة?|المعلمة?"
_NO_NAME_AR = "(?:في|على|من|إلى|عن|مع|هو|هي|هم|أن|إن|لا|ما|لم|لن|قد|كان|كانت|قال|قالت|ذكر|ذكرت|أفاد|أفادت|أكد|أكدت|أعلن|أعلنت|قدم|قدمت|طلب|طلبت|حضر|حضرت|وقع|وقعت|رئيس|رئيسة|مدير|مديرة|وزير|وزيرة|أمين|أمينة|حامل|حاملة|صاحب|صاحبة|بصفته|بصفتها|الذي|التي|هاتف|هاتفه|هاتفها|رقم|عنوانه|عنوانها|بريد)"
_TIE_AR = "(?:عبد|أبو|أبي|أم|ابن|بن|بنت|آل)"

_LAST = rf"(?:(?:[dD]'|O'|Mc|Mac)?[{_L}][a-zß-ÿ]{{2,}}|[{_L}]{{3,}})"
_DOUBLE = rf"{_LAST}(?:-{_LAST})?"
_FIRST = rf"(?:[{_L}][a-zß-ÿ]{{2,}}(?:-[{_L}][a-zß-ÿ]+)?|[{_L}]\.)"
_PARTICLE = r"(?:(?:van|von|de|der|den|del|della|di|da|dos|el|al|bin|ibn)\s+){0,2}"
_MIDDLE = rf"(?:\s+[{_L}]\.)?"
NAME = rf"(?:{_DOUBLE},\s+{_FIRST}{_MIDDLE}|{_FIRST}{_MIDDLE}\s+{_PARTICLE}{_DOUBLE})"
_PART_AR = rf"(?:{_TIE_AR}\s+){{0,2}}(?!{_NO_NAME_AR}(?!{_A})){_A}{{2,}}"
_AFTER_AR = rf"(?=\s*(?:[،؛,.;:()\n\r]|$)|\s+(?:و{_A}|{_NO_NAME_AR}(?!{_A})))"
#: One or two given names and a family name in ال...ي; else a given name and one or two more, up to where the name must end; else two words.
NAME_AR = (
    rf"(?:{_A}{{2,}}(?:\s+{_A}{{2,}})?\s+ال{_A}{{2,}}ي(?!{_A})"
    rf"|(?!ال){_PART_AR}(?:[ \t]+{_PART_AR}){{1,3}}{_AFTER_AR}|(?!ال){_PART_AR}[ \t]+{_PART_AR}(?!{_A}))"
)
# Words for streets, house numbers aside.
_STREET = r"(?:Lane|Street|Road|Avenue|Quay|Square|Drive|Crescent|Terrace|Boulevard|Court|Way|Close|Gardens|Place|Row|Hill|St\.|Ave\.|Rd\.|Blvd\.|Sq\.|Dr\.|Ln\.)"
_STREET_FR = r"(?:rue|avenue|boulevard|place|impasse|chemin|quai|allée)"
_STREET_AR = "(?:شارع|طريق|جادة|زقاق|نهج|ميدان|حارة)"
_ID = rf"(?:[{_L}]{{2}}\s?{_D}{{7}}|{_D}{{3}}\.{_D}{{3}}\.{_D}{{3}}-{_D}{{2}}|{_D}{{2}}-{_D}{{7}}-{_D}|{_D}{{3}}-{_D}{{2}}-{_D}{{4}}|[{_L}]{{2}}\s?(?:{_D}{{2}}\s?){{3}}[A-D]|{_D}{{3}}\s{_D}{{4}}\s{_D}{{3}}|{_D}{{9,10}})"

EMAIL_PATTERN = re.compile(r"[\w.+-]+(?:\s?@\s?|\s?[\[(]at[\])]\s?)[A-Za-z][\w-]*(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z][\w-]*)+", re.I)
_AT = re.compile(r"@|[\[(]at[\])]", re.I)
# Groups of digits of a telephone number, with one sign or bracket between them; `n` to `m` digits after the first.
_GROUPS = rf"(?:[  ./-]?[(]?{_D}[)]?)"
PHONE_PATTERNS = (
    # by shape: any country code after + or 00; area code in brackets; three groups of 3, 3 and 4
    re.compile(rf"(?<![\w/.+-])(?:[+] ?(?![0٠])|(?:00|٠٠)[ -]?(?![0٠])){_D}{_GROUPS}{{6,14}}(?<![  ]{_D})(?![\w-]|[.,/]{_D})"),
    re.compile(rf"(?<![\w/.+-])(?:\({_D}{{2,5}}\)[ -]?{_D}{{3,4}}[ .-]?{_D}{{3,4}}|\({_D}{{3}}\)\s{_D}{{3}}-{_D}{{4}}|{_D}{{3}}([./-]){_D}{{3}}(?:\1|[.\s]){_D}{{4}})(?![\w-]|[.,/]{_D})"),
)
# by the words before: any number of six to fifteen digits
PHONE_CONTEXTS = (
    re.compile(rf"\b(?:tel|telephone|phone|fax|telefax|mobile|cell|cellphone|whatsapp|téléphone|tél|portable)\b\.?(?:\s+(?:no\.?|number|nos\.?))?(?:\s+(?:is|was|at|on))?\s*:?\s*((?:[+]\s?)?[(]?{_D}{_GROUPS}{{5,14}})(?![\w-]|[.,/]{_D})", re.I),
    re.compile(rf"(?<!{_A})[وبل]?(?:ال|لل)?(?:هاتف|فاكس|جوال|محمول|تليفون|تلفون)(?:ه|ها|هم)?(?!{_A})(?:\s+(?:رقم|المحمول|الجوال|هو))?\s*:?\s*((?:[+]\s?)?[(]?{_D}{_GROUPS}{{5,14}})(?![\w-]|[.,/]{_D})"),
)
ID_PATTERNS = (
    re.compile(rf"\b(?:passport|identity card|identity number|identity document|ID number|ID card|ID|SSN|social security(?: number)?|national insurance(?: number)?|tax number|licen[cs]e number)(?:\s+(?:no\.|number|is|was))*\s*:?\s+({_ID})(?!\w)", re.I),
    re.compile(rf"(?:جواز السفر|جواز سفر|بطاقة الهوية|بطاقة هوية|رقم الهوية|الرقم القومي)(?:\s+(?:رقم|هو))*\s*:?\s+({_ID})(?!\w)"),
    re.compile(rf"رقم\s+هوية\s+(?:{NAME_AR})\s+هو\s+({_ID})(?!\w)"),
    re.compile(rf"(?<![\w/.-])((?!000|666|9){_D}{{3}}-(?!00){_D}{{2}}-(?!0000){_D}{{4}})(?![\w-]|[.,/]{_D})"),
)
ADDRESS_PATTERN = re.compile(
    rf"(?:(?<![\d/,.-])(?:No\.\s*)?{_D}{{1,4}}[A-Z]?,?[ ][{_L}][a-zß-ÿ]+(?:[ ][{_L}][a-zß-ÿ]+)?\s+{_STREET}(?!\w)(?!\s+(?:market|will|was|is|has)\b)|[{_L}][a-zß-ÿ]+\s+{_STREET},?\s+(?:No\.\s*)?{_D}{{1,4}}[A-Z]?(?!\w)"
    rf"|(?<![\d/,.-]){_D}{{1,4}}(?:\s?bis)?,?\s{_STREET_FR}\s(?:de\sla\s|de\sl'|des\s|du\s|de\s|d')?[{_L}][\w-]+"
    rf"|{_STREET_AR}\s+{_A}+(?:\s+ال{_A}+)?،\s+رقم\s+{_D}{{1,4}}(?!\w)|{_D}{{1,4}}\s+{_STREET_AR}\s+{_A}+(?:\s+ال{_A}+)?)"
)
# A name after a title, a role or a label.
NAME_CUES = tuple(
    re.compile(x)
    for x in (
        rf"\b(?:{TITLES})\.?\s+({NAME})", rf"\((?:[Ss]igned|[Ss]igné)\)\s+({NAME})", rf"\b(?:[Nn]ame|[Cc]ontact|[Aa]ttn|[Ss]igned|(?i:{ROLES}))\s*[:,]\s+({NAME})(?=\s*[,.;:(\n]|\s+\w|$)",
        rf"\b(?:our|the|his|her|their|my|your|a)\s+(?:\w+\s+)?(?:{ROLES})\s+({NAME})", rf"\b(?:[Ss]igned|[Ww]ritten|[Pp]repared|[Tt]aken|[Rr]eported|[Dd]rafted|[Cc]ompiled)\s+by\s+({NAME})(?=\s*[,.;:\n]|$)",
        rf"(?<!{_A})[وبل]?(?:ال|لل)?(?:{TITLES_AR})\s+({NAME_AR})(?!{_A})", rf"(?<!{_A})(?:{ROLES_AR})[:،]?\s+({NAME_AR})(?!{_A})", rf"\(توقيع\)\s+({NAME_AR})(?=\s|$)",
    )
)
#: A name right before contact details: at most a few words of a label stand between.
_NAME_END = re.compile(rf"({NAME}|(?<!{_A})(?!{_NO_NAME_AR}(?!{_A})){_A}{{2,}}(?:\s+{_A}{{2,}})?\s+ال{_A}{{2,}}ي(?!{_A}))(?:\s*[;,(]\s*|\s+)(?:(?:tel|telephone|phone|fax|e-mail|email|staff|holder|passport|identity|number|no|of|on|at|ID|هاتف|هو|على|الرقم|العنوان|بريد|حامل|جواز|السفر|رقم)[.:]?\s*){{0,5}}[(:]?\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_CAPITAL = re.compile(rf"[{_L}][a-zß-ÿ]{{2,}}(?:-[{_L}][a-zß-ÿ]+)?|{_A}{{3,}}")
_REST = re.compile(rf"{_MIDDLE}\s+{_PARTICLE}({_DOUBLE})(?![\w'’])")
_END_AR = re.compile(_AFTER_AR)
_REST_AR = re.compile(rf"(?:\s+{_PART_AR})?\s+(ال{_A}{{2,}}ي)(?!{_A})|\s+({_PART_AR})(?!{_A})")
_LED = re.compile(rf"(?:[{_L}]\.|([{_L}][\w-]+))\s+$")
_MIDDLE_AT = re.compile(_MIDDLE)
_BEFORE = re.compile(rf"({_DOUBLE}),\s+$")
_INITIAL = re.compile(rf"(?<![\w.])([{_L}]\.)(?:\s+[{_L}]\.)?\s+({_DOUBLE})(?![\w'’])")


@dataclass
class Names:
    """Dictionaries: given and family names (learnt from a bounded sample, and fixed), and words that are seen in small letters."""

    given: frozenset[str]
    family: frozenset[str]
    small: frozenset[str]

    def kind(self, word: str) -> str:
        low = word.lower()
        return ("g" if low in self.given else "") + ("f" if low in self.family else "") + ("s" if low in self.small else "") + _KINDS.get(low, "")


_KINDS = {w.lower(): k for k, group in (("t", TITLES), ("r", ROLES), ("t", TITLES_AR)) for w in group.split("|")}
NO_NAMES = Names(GIVEN | GIVEN_AR, frozenset(), frozenset())


def _numbers(text: str, add) -> None:
    if _AT.search(text):
        for m in EMAIL_PATTERN.finditer(text):
            add(m.start(), m.end(), 1)
    for p in ID_PATTERNS:
        for m in p.finditer(text):
            add(*m.span(1), 3)
    for p in PHONE_PATTERNS:
        for m in p.finditer(text):
            add(*m.span(), 2)
    for p in PHONE_CONTEXTS:
        for m in p.finditer(text):
            add(*m.span(1), 2)
    for m in ADDRESS_PATTERN.finditer(text):
        add(*m.span(), 4)


def _known(text: str, names: Names, add) -> None:
    """Names that begin with a given name of the dictionary and go on with a word that is no common one."""
    for m in _CAPITAL.finditer(text):
        word = m[0].lower()
        first = word.split("-")[0]
        stem = word if word in names.given else word[1:] if word[:1] in "وبل" and word[1:] in names.given else None
        if stem is None and first not in names.given:
            continue
        start = m.start() + (stem is not None and stem != word)
        if word[0] >= "ء":
            rest = _REST_AR.match(text, m.end())
            if rest and (rest[1] or rest[2] in names.family or rest[2] in names.given or (start == m.start() and _END_AR.match(text, rest.end()))):
                add(start, rest.end(), 0)
            continue
        before = _BEFORE.search(text, max(0, m.start() - 60), m.start())
        rest = _REST.match(text, m.end())
        inverted = before and (before[1].isupper() or before[1].lower() in names.family)
        if inverted and (led := _LED.search(text, max(0, before.start() - 30), before.start())) and (led[1] is None or led[1].lower() in names.given):
            inverted = False  # the family name has its first name before it
        if inverted and add(before.start(1), _MIDDLE_AT.match(text, m.end()).end(), 0):
            continue
        if rest and rest[1].lower() not in names.small and rest[1] not in ("The", "This", "That", "In", "On", "At"):
            add(start, rest.end(), 0)
    for m in _INITIAL.finditer(text):
        if m[2].lower() in names.family:
            add(*m.span(), 0)


def _taker(length: int, out: list[tuple[int, int, int]]):
    """A function that adds a piece to `out` unless it overlaps with one there."""
    taken = np.zeros(length + 1, bool)
    for a, b, _ in out:
        taken[a:b] = True

    def add(a: int, b: int, kind: int) -> bool:
        free = not taken[a:b].any()
        if free:
            taken[a:b] = True
            out.append((a, b, kind))
        return free

    return add


def cued(text: str) -> list[tuple[int, int, int]]:
    """(start, end, type) of what the cues find without a dictionary; the earlier cue wins where two overlap."""
    out: list[tuple[int, int, int]] = []
    add = _taker(len(text), out)
    _numbers(text, add)
    details = sorted(a for a, _, k in out if k in (1, 2, 3))
    for p in NAME_CUES:
        for m in p.finditer(text):
            add(*m.span(1), 0)
    for a in details:
        m = _NAME_END.search(text, max(0, a - 110), a)
        if m:
            add(*m.span(1), 0)
    return out


def label(text: str, names: Names = NO_NAMES, found: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, type) of what the cues find (`found`, if they ran before), and of what begins with a known given name."""
    out = list(cued(text) if found is None else found)
    _known(text, names, _taker(len(text), out))
    return sorted(out)


def learn_names(texts: list[str], found: list[list[tuple[int, int, int]]]) -> Names:
    """Given and family names that cues lead to, twice at least and in one of twenty of the word's places; and the words seen in small letters."""
    seen: Counter[str] = Counter()
    small: set[str] = set()
    for t in texts:
        for w in _WORD.findall(EMAIL_PATTERN.sub(" ", t) if _AT.search(t) else t):
            low = w.lower()
            seen[low] += 1
            if w == low and w < "ء":
                small.add(w)
    given, family = Counter(), Counter()
    for t, own in zip(texts, found, strict=True):
        for a, b, kind in label(t, found=own):
            if kind == 0:
                piece = t[a:b]
                parts = _WORD.findall(", ".join(reversed(piece.split(", ", 1))))
                if len(parts) > 1:
                    if len(parts[0]) > 2:
                        given[parts[0].lower()] += 1
                    for w in parts[1:]:
                        if len(w) > 2:
                            family[w.lower()] += 1
    often = lambda found: {w for w, n in found.items() if n > 1 and 20 * n >= seen[w] and w not in small and w not in _KINDS}
    return Names(GIVEN | GIVEN_AR | frozenset(often(given)), frozenset(often(family)), frozenset(small))


# ---------------------------------------------------------------------------------------------------------------
# Tokens and features.

OTHER, WORD, DIGITS, SPACE = 0, 1, 2, 3
_table: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _table:
        t = np.zeros(flat.TABLE, np.uint8)
        t[flat.by_category(("L", "M"))] = WORD
        t[flat.by_category(("N",))] = DIGITS
        t[np.fromiter((chr(i).isspace() for i in range(flat.TABLE)), bool, flat.TABLE)] = SPACE
        _table.append(t)
    return _table[0]


def tokens(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, gap) of the tokens: words, numbers and single signs; gap: 0 none before, 1 white space, 2 a line end."""
    n = len(points)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    kind = flat.look_up(classes(), points)
    new = np.zeros(n + 1, bool)
    new[rows] = True
    new[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == OTHER)
    start = np.flatnonzero(new[:n])
    end = np.append(start[1:], n)
    lines = np.concatenate(([0], np.cumsum(points == 10)))
    token = kind[start] != SPACE
    start, end = start[token], end[token]
    before = np.concatenate(([0], end[:-1]))
    return start, end, (start > before).astype(np.int64) + (lines[start] > lines[before])


def _shape(word: str) -> str:
    if word[0].isdigit():
        return "9" * min(len(word), 12)
    if not word[0].isalpha():
        return word
    if word[0] >= "֐":
        return "ar"
    if len(word) == 1:
        return "X" if word.isupper() else "x"
    return "XX" if word.isupper() else "Xx" if word[0].isupper() else "xx"


def _ties(word: str) -> bool:
    """Whether occurrences of a word are joined by skip edges: words of four letters and more that can be names."""
    return len(word) > 3 and word[0].isalpha() and not word.islower()


def features(word: str, names: Names = NO_NAMES) -> tuple[list[str], list[str]]:
    """(features of a token where it stands, features it has for its neighbours); the first of either tell of more than the word itself."""
    low = ("9" * len(word)) if word[0].isdigit() else word.lower()
    shape = _shape(word)
    kind = names.kind(word)
    own = ["s" + shape, "d" + kind, "l" + str(min(len(low), 9)) + shape[:2], "w" + low, "e" + low[-4:], "f" + low[-2:], "b" + low[:3]]
    return own, ["s" + shape, "d" + kind, "w" + low]


OWN, NEAR = 7, 3
#: So many features of a token, and of a neighbour, hold for words never seen.
OWN_OPEN, NEAR_OPEN = 3, 2
OFFSETS = [k for k in range(-REACH, REACH + 1) if k]
_PLACES = {k: zlib.crc32(str(k).encode()) for k in (0, *OFFSETS)}


def indices(word: str, names: Names = NO_NAMES) -> list[int]:
    """Buckets of a token's features: at its own place, then for the token each offset away that sees it."""
    own, near = features(word, names)
    near = [x.encode() for x in near]
    # a checksum goes on from that of the place's number
    return [zlib.crc32(x.encode(), _PLACES[0]) % BUCKETS for x in own] + [zlib.crc32(x, _PLACES[k]) % BUCKETS for k in OFFSETS for x in near]


GAPS = [zlib.crc32(f"gap{k}{g}".encode()) % BUCKETS for k in (0, 1) for g in (0, 1, 2)]


@dataclass
class Model:
    """Arrays of fixed size (about 3 MB) and the dictionaries of the sample."""

    unary: np.ndarray
    step: np.ndarray
    skip: float
    names: Names


def _spans_to_labels(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(len(start), np.int64)
    for a, b, kind in spans:
        i, j = np.searchsorted(start, a), np.searchsorted(end, b, side="right")
        if i < j:
            out[i:j] = 2 + 2 * kind
            out[i] = 1 + 2 * kind
    return out


def _gather(table: np.ndarray, kind: np.ndarray, row: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Buckets of every token with its neighbours in the same row; -1 for none."""
    n = len(kind)
    parts = [table[kind, :OWN]]
    for j, k in enumerate(OFFSETS):
        seen = np.full((n, NEAR), -1, np.int32)
        # what the token at i + k says to the one at i
        a, b = (slice(0, n - k), slice(k, n)) if k > 0 else (slice(-k, n), slice(0, n + k))
        same = row[a] == row[b]
        seen[a][same] = table[kind[b], OWN + j * NEAR : OWN + (j + 1) * NEAR][same]
        parts.append(seen)
    ahead = np.append(gap[1:], 1)
    parts.append(np.array(GAPS, np.int32)[np.stack((gap, 3 + ahead), axis=1)])
    return np.concatenate(parts, axis=1)


# Plain sentences that join the sample, so that the model also learns forms a collection may lack; n and m stand for names,
# s for a street with its number, p, i and e for telephone and identity numbers and an email address.
FRAMES = (
    "Last week {n} met {m} in the garden behind the school.", "On Monday {n} wrote to {m} about the roof.", "I asked {n} to call {m} before the end of the day.", "My neighbour {n} moved to {s} in the spring.", "{n} lives at {s} with two cats.", "Please send the parcel to {n}, {s}, second floor.",
    "Their lawyer {n} said the file was lost.", "The nurse {n} can be reached at {p} after six.", "Call {n} on {p} or write to {e}.", "Her social security number is {i} and her phone is {p}.", "The form shows {i} for {n}.", "{n} ({i}) signed for the keys.", "When {n} left, {m} took over the shop.",
    "We thank {n} and {m} for their help.", "The letter from {n} arrived in March.", "{n}, who had worked there since 1998, told the court nothing new.", "Tomorrow {n} will open the market.", "Later {n} said that the bridge was safe.", "Mail: {e}; mobile {p}.", "The house at {s} was sold to {n}.", "Nobody had seen {n} since the storm, said {m}.",
    "Yours sincerely, {n}", "The school on the hill has a new head, {n}.", "In the morning {n} found the door open.", "The River Committee met in Northport.", "Green Valley School closed in May.", "The Old Bridge Fund paid 12,500 dollars to the Town Council.", "Order 445-20-118 of 3 May was cancelled.", "The Spring Prize went to the Harbour Choir.", "Every Sunday the Market Hall opens at nine.",
    "التقى {a} أمس مع {b} في الحديقة.", "كتب {a} إلى {b} عن السقف.", "قال {a} إن الجسر آمن.", "اتصل بـ {a} على الرقم {p} بعد الظهر.", "عقدت لجنة النهر اجتماعها في المدينة.",
)
FRAME_TEXTS = 600


def frame_texts(names: Names, rng: np.random.Generator) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Filled frames and where their pieces stand: given names of the dictionary, made-up family names, streets and numbers."""
    latin, arabic = (sorted(w for w in names.given if (w[0] >= "ء") == x) for x in (False, True))
    digits = lambda n: "".join(map(str, rng.integers(1, 10, n)))
    pick = lambda options: options[int(rng.integers(len(options)))]

    def name() -> str:
        first, last = pick(latin).capitalize(), _unseen(pick(("Carden", "Mollison", "Berg", "Tavares", "Okoroma")), rng)
        return pick((f"{first} {last}", f"{first} {last}", f"{first} {digits(0) or 'ABCDEFGHJKLMNPRST'[int(rng.integers(17))]}. {last}", f"{first} {last}-{_unseen('Alder', rng)}"))

    def arabic_name() -> str:
        return f"{pick(arabic)} {pick((_unseen('الحسني', rng), _unseen('منصور', rng)))}"

    fill = {
        "n": (name, 0), "m": (name, 0), "a": (arabic_name, 0), "b": (arabic_name, 0), "e": (lambda: f"{_unseen('writer', rng)}@{_unseen('house', rng)}.{pick(('org', 'net', 'example'))}", 1),
        "p": (lambda: pick((f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}")), 2),
        "i": (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", 3), "s": (lambda: f"{digits(int(rng.integers(1, 4)))} {_unseen('Marlow', rng)} {pick(('Street', 'Road', 'Lane', 'Avenue', 'Close', 'Hill'))}", 4),
    }
    texts, spans = [], []
    for k in range(FRAME_TEXTS):
        text, own = "", []
        for part in re.split(r"(\{\w\})", FRAMES[k % len(FRAMES)]):
            if part[:1] == "{":
                make, kind = fill[part[1]]
                part = make()
                own.append((len(text), len(text) + len(part), kind))
            text += part
        texts.append(text)
        spans.append(own)
    return texts, spans


#: In training, which word a name's token is (not its shape or dictionaries) is hidden from itself and its neighbours this often.
HIDDEN = 0.3


def train(texts: list[str], found: list[list[tuple[int, int, int]]] | None = None, epochs: int = 6, seed: int = 7) -> Model:
    """Fit the potentials to the texts, labelled by the cues (`found`, if they ran before) and by the names these lead to."""
    rng = np.random.default_rng(seed)
    found = [cued(t) for t in texts] if found is None else found
    names = learn_names(texts, found)
    spans = [label(t, names, own) for t, own in zip(texts, found, strict=True)]
    known = names.given | names.family
    if texts:
        more, told = frame_texts(names, rng)
        texts, spans = texts + more, spans + told
    text = pa.array(texts, pa.string())
    points, rows = flat.code_points(text)
    start, end, gap = tokens(points, rows)
    if not len(start):
        return Model(np.zeros((BUCKETS + 1, LABELS), np.float32), np.zeros((LABELS, LABELS), np.float32), 0.0, names)
    row = np.searchsorted(rows, start, side="right") - 1
    first, kind = flat.distinct_spans(points, start, end)
    words = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    label_of = _spans_to_labels(start, end, [(int(rows[i]) + a, int(rows[i]) + b, k) for i, s in enumerate(spans) for a, b, k in s])
    # A known name outside the patterns is neither a name nor none for certain: such places are not learnt from.
    is_name = np.fromiter((w.lower() in known for w in words), bool, len(words))[kind]
    unsure = (label_of == 0) & is_name
    near = np.zeros(len(start), bool)
    for i in np.flatnonzero(label_of).tolist():
        near[max(0, i - 6) : i + 7] = True
    telling = np.fromiter((w[0].isdigit() or w[0].isupper() for w in words), bool, len(words))[kind]
    chance = np.where(near, 1.0, np.where(telling, 0.35, 0.08))
    use = np.flatnonzero((rng.random(len(start)) < chance) & ~unsure)
    table = np.array([indices(w, names) for w in words], np.int32)
    x = _gather(table, kind, row, gap)
    x[x < 0] = BUCKETS
    named = (label_of + 1) // 2 == 1
    away = np.array([*[0] * (OWN - OWN_OPEN), *(k for k in OFFSETS for _ in range(NEAR_OPEN, NEAR))])
    identity = np.array([*range(OWN_OPEN, OWN), *(OWN + j * NEAR + k for j in range(len(OFFSETS)) for k in range(NEAR_OPEN, NEAR))])
    weight = np.zeros((BUCKETS + 1, LABELS), np.float32)
    square = np.full((BUCKETS + 1, 1), 1e-2, np.float32)
    for _ in range(epochs):
        rng.shuffle(use)
        for a in range(0, len(use), 1024):
            at = use[a : a + 1024]
            mine = x[at]
            mine[:, identity] = np.where(named[np.clip(at[:, None] + away, 0, len(named) - 1)] & (rng.random((len(at), len(identity))) < HIDDEN), BUCKETS, mine[:, identity])
            score = weight[mine].sum(axis=1)
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), label_of[at]] -= 1
            flat_x = mine.ravel()
            there = np.flatnonzero(flat_x != BUCKETS)
            order = np.argsort(flat_x[there].astype(np.uint16), kind="stable")  # 16 bits: a radix sort
            ordered = flat_x[there[order]]
            begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            bucket = ordered[begin]
            g = np.add.reduceat(p[there[order] // x.shape[1]], begin, axis=0).astype(np.float32)
            square[bucket] += (g * g).mean(axis=1, keepdims=True)
            weight[bucket] -= 0.25 * g / np.sqrt(square[bucket]) + 1e-5 * weight[bucket]
            weight[BUCKETS] = 0
    # Transitions: how much likelier a label is after another than anywhere.
    pair = np.full((LABELS, LABELS), 0.5)
    inner = row[1:] == row[:-1]
    np.add.at(pair, (label_of[:-1][inner], label_of[1:][inner]), 1)
    step = np.log(pair / pair.sum(axis=1, keepdims=True)) - np.log(pair.sum(axis=0) / pair.sum())[None, :]
    step = np.clip(step, -3, 3)
    for y in range(LABELS):
        for z in range(2, LABELS, 2):
            if y not in (z, z - 1):
                step[y, z] = -25
    model = Model(weight, step.astype(np.float32), 0.0, names)
    model.skip = _fit_skip(model, texts, spans, rng)
    return model


#: The weights tried for skip edges, and on how many texts at most.
SKIP_WEIGHTS, SKIP_TEXTS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 14.0), 300


def _fit_skip(model: Model, texts: list[str], spans: list[list[tuple[int, int, int]]], rng: np.random.Generator) -> float:
    """The smallest weight of skip edges that finds the most names right (F1) in texts made for it.

    Each is a text with a name in telling surroundings, in which the name is changed for one not seen before and stands
    once more, in the place of a capitalised word (or, in Arabic, any longer word) of a sentence from another text.
    """
    plain = [m[0] for t, s in zip(texts, spans, strict=True) if not s for m in [re.search(r"[^\n.]{40,200}\.", t)] if m]
    made, truth = [], []
    for k in rng.permutation(len(texts)).tolist():
        if len(made) == SKIP_TEXTS or not plain:
            break
        own = [(a, b) for a, b, kind in spans[k] if kind == 0 and len(texts[k]) < 2000]
        if not own:
            continue
        name = texts[k][own[0][0] : own[0][1]]
        arabic = name[-1] >= "ء"
        sentence = plain[int(rng.integers(len(plain)))]
        places = [m.span() for m in re.finditer(r"(?<=[a-z,] )[A-ZÀ-Þ][a-zß-ÿ]{3,}|(?<= )[ء-ي]{5,}", sentence) if (sentence[m.start()] >= "ء") == arabic]
        if not places or "," in name:
            continue
        a, b = places[int(rng.integers(len(places)))]
        new = _WORD.sub(lambda m: _unseen(m[0], rng), name)
        text = texts[k].replace(name, new) + "\n" + sentence[:a] + new + sentence[b:]
        made.append(text)
        truth.append({(m.start(), m.end()) for m in re.finditer(re.escape(new), text)} | {(m.start(), m.end()) for x, y in own for m in re.finditer(re.escape(texts[k][x:y].replace(name, new)), text)})
    best, chosen = -1.0, 0.0
    for weight in SKIP_WEIGHTS if made else ():
        finder = Finder(Model(model.unary, model.step, weight, model.names))
        row, start, end, kind = finder.find(pa.array(made, pa.string()))
        found = {(r, x, y) for r, a, b, k in zip(row.tolist(), start.tolist(), end.tolist(), kind.tolist(), strict=True) if k == 0 for x, y in bounds(made[r], a, b, 0, model.names)}
        want = {(i, *p) for i, t in enumerate(truth) for p in t}
        score = 2 * len(found & want) / max(1, len(found) + len(want))
        if score > best + 1e-3:
            best, chosen = score, weight
    return chosen


def _unseen(word: str, rng: np.random.Generator) -> str:
    """A word of the same shape that no dictionary has."""
    if len(word) < 3:
        return word
    if word[0] >= "ء":
        lead, tail = ("ال", "ي") if word.startswith("ال") and word.endswith("ي") else ("", "")
        return lead + "".join(rng.choice(list("بدرسشعفقكلمنوي"), max(3, len(word) - len(lead) - len(tail)))) + tail
    out = "".join(rng.choice(list("bcdfgklmnprstvz" if i % 2 else "aeiou")) for i in range(1, len(word) + 1))
    return out.upper() if word.isupper() else out.capitalize() if word[0].isupper() else out


# ---------------------------------------------------------------------------------------------------------------
# Inference.


class Finder:
    """Applies a model; remembers the scores of up to MEMORY distinct tokens."""

    MEMORY = 60_000

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.score = np.zeros((1 << 12, len(OFFSETS) + 1, LABELS), np.float32)
        # a row of zeros is what a missing neighbour says
        self.gap_own = model.unary[GAPS[:3]]
        self.gap_next = model.unary[GAPS[3:]]

    def slots(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > self.MEMORY:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            n = len(self.known)
            while n + len(new) > len(self.score):
                self.score = np.concatenate((self.score, np.zeros_like(self.score)))
            w = self.model.unary[np.array([indices(x, self.model.names) for x in new], np.int64)]
            self.score[n : n + len(new), 0] = w[:, :OWN].sum(axis=1)
            for j in range(len(OFFSETS)):
                self.score[n : n + len(new), j + 1] = w[:, OWN + j * NEAR : OWN + (j + 1) * NEAR].sum(axis=1)
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def find(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, type) of the pieces in a slice of texts; offsets count code points of the row."""
        none = (np.zeros(0, np.int64),) * 4
        points, rows = flat.code_points(text)
        start, end, gap = tokens(points, rows)
        n = len(start)
        if n == 0:
            return none
        row = np.searchsorted(rows, start, side="right") - 1
        first, kind = flat.distinct_spans(points, start, end)
        lengths = (end - start)[first]
        joined = points[flat.ranges(start[first], lengths)].tobytes().decode("utf-32-le")
        cuts = np.concatenate(([0], np.cumsum(lengths))).tolist()
        words = [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        slot = self.slots(words)[kind]
        unary = self.score[slot, 0]
        for j, k in enumerate(OFFSETS):
            a, b = (slice(0, n - k), slice(k, n)) if k > 0 else (slice(-k, n), slice(0, n + k))
            if abs(k) >= n:
                continue
            unary[a] += self.score[slot[b], j + 1] * (row[a] == row[b])[:, None]
        unary += self.gap_own[gap]
        unary += self.gap_next[np.append(gap[1:], 1)]
        odds = unary[:, 1:].max(axis=1) - unary[:, 0]
        open_ = odds > -GATE
        if not open_.any():
            return none
        # Other occurrences of an open token of a name are open too.
        capital = np.fromiter(map(_ties, words), bool, len(words))[kind]
        key = row * len(words) + kind
        likely = open_ & capital & (odds > -1)
        if likely.any():
            open_ |= capital & np.isin(key, np.unique(key[likely]))
        spread_ = open_.copy()
        for k in (1, 2, 3):
            spread_[k:] |= open_[:-k]
            spread_[:-k] |= open_[k:]
        at = np.flatnonzero(spread_)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
        label_of = np.zeros(n, np.int64)
        label_of[at] = self.infer(unary[at], new, key[at], capital[at])
        begin = np.flatnonzero(label_of % 2 == 1)
        if not len(begin):
            return none
        inside = (label_of > 0) & (label_of % 2 == 0)
        stop = np.flatnonzero(~np.append(inside, False))
        last = stop[np.searchsorted(stop, begin + 1)] - 1
        r = row[begin]
        return r, start[begin] - rows[r], end[last] - rows[r], (label_of[begin] - 1) // 2

    def infer(self, unary: np.ndarray, new: np.ndarray, key: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Labels of chains laid end to end; `new` marks their first tokens, equal keys among the tied are joined by skip edges."""
        chain = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(new)))
        place = np.arange(len(new)) - begin[chain]
        message = np.zeros((len(unary), LABELS), np.float32)
        order = np.lexsort((np.arange(len(key)), key))
        order = order[tied[order]]
        same = key[order][1:] == key[order][:-1]
        left, right = order[:-1][same], order[1:][same]
        if len(left) and self.model.skip > 0:
            to_left = np.zeros((len(left), LABELS), np.float32)
            to_right = np.zeros((len(left), LABELS), np.float32)
            strength = np.float32(np.expm1(self.model.skip))
            for _ in range(ROUNDS):
                belief = self.marginals(unary + message, chain, place, length)
                # what a token tells another is its belief without what it was told by it
                for source, told, out in ((left, to_left.copy(), to_right), (right, to_right.copy(), to_left)):
                    pure = belief[source] * np.exp(-told)
                    pure /= pure.sum(axis=1, keepdims=True)
                    name = pure[:, 1] + pure[:, 2]
                    sent = np.ones((len(source), LABELS), np.float32)
                    sent[:, 1:3] += strength * name[:, None]  # the potential favours two names, not two words outside
                    out[:] = np.log(sent) - np.log(sent).max(axis=1, keepdims=True)
                message[:] = 0
                np.add.at(message, left, to_left)
                np.add.at(message, right, to_right)
        return self.best(unary + message, chain, place, length)

    def _batches(self, length: np.ndarray):
        """Chains of like length, so that little of a matrix is padding."""
        order = np.argsort(length, kind="stable")
        a = 0
        while a < len(order):
            longest = max(16, int(length[order[a]]) * 2)
            b = min(int(np.searchsorted(length[order], longest, side="right")), a + max(1, 400_000 // longest))
            yield order[a : max(b, a + 1)]
            a = max(b, a + 1)

    def _lay(self, values, length, begin, chains):
        wide = int(length[chains].max())
        where = np.minimum(begin[chains][:, None] + np.arange(wide)[None, :], len(values) - 1)
        inside = np.arange(wide)[None, :] < length[chains][:, None]
        return where, inside, wide

    def marginals(self, unary, chain, place, length):
        begin = np.cumsum(length) - length
        out = np.zeros_like(unary)
        step = np.exp(self.model.step)
        e = np.exp(unary - unary.max(axis=1, keepdims=True))
        for chains in self._batches(length):
            where, inside, wide = self._lay(unary, length, begin, chains)
            forward = np.zeros((wide, len(chains), LABELS), np.float32)
            start = np.ones(LABELS, np.float32)
            start[2::2] = 1e-9
            for t in range(wide):
                f = e[where[:, t]] * (start if t == 0 else forward[t - 1] @ step)
                forward[t] = f / np.maximum(f.sum(axis=1, keepdims=True), 1e-30)
            back = np.ones((len(chains), LABELS), np.float32)
            for t in range(wide - 1, -1, -1):
                mine = inside[:, t]
                b = forward[t] * back
                b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-30)
                out[where[mine, t]] = b[mine]
                sent = (e[where[:, t]] * back) @ step.T
                sent /= np.maximum(sent.sum(axis=1, keepdims=True), 1e-30)
                back = np.where(mine[:, None], sent, 1.0).astype(np.float32)
        return out

    def best(self, unary, chain, place, length):
        begin = np.cumsum(length) - length
        out = np.zeros(len(unary), np.int64)
        step = self.model.step
        for chains in self._batches(length):
            where, inside, wide = self._lay(unary, length, begin, chains)
            came = np.zeros((wide, len(chains), LABELS), np.int8)
            score = unary[where[:, 0]].copy()
            score[:, 2::2] -= 25
            for t in range(1, wide):
                both = score[:, :, None] + step[None, :, :]
                came[t] = both.argmax(axis=1)
                nxt = both.max(axis=1) + unary[where[:, t]]
                score = np.where(inside[:, t][:, None], nxt, score)
            y = score.argmax(axis=1)
            for t in range(wide - 1, -1, -1):
                mine = inside[:, t]
                out[where[mine, t]] = y[mine]
                if t:
                    y = np.where(mine, came[t][np.arange(len(chains)), y], y)
        return out


# Street words written with a full stop.
ABBREVIATIONS = ("St", "Ave", "Rd", "Blvd", "Sq")
# Words that may stand after a name but are no part of it.
_AFTER = re.compile(r"(?:[\s.,;:]+(?:Mr|Mrs|Ms|Dr|Prof|on|and|in|of|the|was|is|at|to|في|على|و|من|إلى|هو|The|A|\())*[\s.,;:(]*$")


_SMALL = re.compile(r"\s+(?!(?:van|von|de|der|den|del|della|di|da|dos|el|al|bin|ibn)\s)[a-zß-ÿ]+\s+")
_SOCIAL = re.compile(rf"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}")


def settled_type(piece: str, kind: int) -> int:
    """The type of a found piece: a number in the form of a social security number is no telephone number."""
    return 3 if kind == 2 and _SOCIAL.fullmatch(piece) else kind


def bounds(text: str, start: int, end: int, kind: int, names: Names = NO_NAMES) -> list[tuple[int, int]]:
    """Where the pieces of a found span really begin and end; none if it can be no piece of its type.

    Numbers end with a digit and before the next sentence; addresses have a number, and a full stop only after an
    abbreviation; what stands on both sides of a comma is two names, unless the first is a family name alone; so is what
    stands on both sides of a word in small letters that is no particle; a name that holds a given name of the dictionary
    begins with a name or an initial.
    """
    piece = text[start:end]
    digits = sum(c.isdigit() for c in piece)
    if kind in (2, 3):
        cut = re.search(r"[.,;:]\s|\s[^\W\d_]{2}" if kind == 2 else r"[.,;:]\s", piece)
        piece = piece[: cut.start()] if cut else piece
        line = piece.find("\n")
        if line > 0 and sum(c.isdigit() for c in piece[:line]) >= (10 if kind == 2 else 9):
            piece = piece[:line]
        while piece and not piece[-1].isdigit():
            piece = piece[:-1]
        digits = sum(c.isdigit() for c in piece)
        if kind == 2 and re.search(r"\d[  ]$", text[max(0, start - 2) : start]):  # the end of a longer number
            return []
        return [(start, start + len(piece))] if digits >= 6 else []
    if kind == 1:
        before = re.search(r"[\w.+-]+$", text[max(0, start - 80) : start])
        if before and start + 1 < end and re.match(r"[\w.+-]", text[start]):  # the beginning of the same address
            start, piece = start - len(before[0]), before[0] + piece
        piece = piece.rstrip(".,;:>")
        first = re.search(r"^[^@\[(]*[,;]\s+", piece)
        if first:
            start, piece = start + first.end(), piece[first.end() :]
        return [(start, start + len(piece))] if re.search(r"@|[\[(]at[\])]", piece, re.I) and re.search(r"\.|dot", piece, re.I) else []
    if kind == 4:
        line = piece.rfind("\n") + 1
        if line and ADDRESS_PATTERN.match(piece, line):
            start, piece = start + line, piece[line:]
        cut = re.search(r"(?<!No)(?<!St)(?<!Ave)(?<!Rd)(?<!Blvd)(?<!Sq)\.\s", piece)
        piece = (piece[: cut.start()] if cut else piece).rstrip(" .,;:\n")
        if piece.endswith(ABBREVIATIONS) and text[start + len(piece) : start + len(piece) + 1] == ".":
            piece += "."
        return [(start, start + len(piece))] if digits and len(piece) > 4 else []
    out: list[tuple[int, int]] = []
    family = False  # the part before was a family name alone: its first name follows
    piece = piece.split("\n\n")[0]
    line = piece.rfind("\n")
    if line > 0 and len(piece[:line].split()) > 1 and names.family.isdisjoint(piece[line:].lower().split()):
        piece = piece[:line]
    whole = _SMALL.sub(lambda m: "," * len(m[0]), piece)
    for m in re.finditer(r"[^,]+", whole):
        own = _AFTER.sub("", m[0])
        lead = len(own) - len(own.lstrip())
        words = own.split()
        while len(words) > 1 and _KINDS.get(words[0].rstrip(".").lower()) == "t":
            lead = own.index(words[1], lead + len(words[0]))
            words = words[1:]
        while len(words) > 2 and words[1].lower() in names.given and not (words[0].lower() in names.given or words[0].lower() in names.family or words[0].endswith(".") or words[0][0] >= "ء"):
            lead = own.index(words[1], lead + len(words[0]))
            words = words[1:]
        if family:
            out[-1] = (out[-1][0], start + m.start() + len(own))
        elif words:
            out.append((start + m.start() + lead, start + m.start() + len(own)))
        family = not family and len(words) == 1
    return [(x, y) for x, y in out if len(text[x:y].split()) > 1]


# ---------------------------------------------------------------------------------------------------------------
# Spark.


def fit(documents: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most `sample_docs` distinct texts of at most `sample_chars` characters: those with the smallest hashes.

    A first bound on the hash, from about the number of distinct texts, leaves about twice the sample; copies of those
    are merged where they are read, and only what is left is sorted and sent.  The cues run on the executors; the driver
    fits a model of fixed size to the bounded sample.
    """
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    own = documents.select(F.col(text).cast("string").alias("text")).filter(F.length("text").between(1, sample_chars)).withColumn("h", hashed)
    distinct = own.agg(F.approx_count_distinct("text")).first()[0]
    bound = min(1 << 30, int(2 * sample_docs / max(1, distinct) * (1 << 30)) + 1)
    chosen = own.filter(F.col("h") < bound).dropDuplicates(["h", "text"]).orderBy("h", "text").limit(sample_docs)

    def run(batches):
        for batch in batches:
            spans = [[{"a": a, "b": b, "kind": k} for a, b, k in cued(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([(c, pa.int32()) for c in ("a", "b", "kind")])))], ["h", "text", "found"])

    cores = documents.sparkSession.sparkContext.defaultParallelism
    rows = chosen.select("h", "text").repartition(cores, "text").mapInArrow(run, "h bigint, text string, found array<struct<a: int, b: int, kind: int>>").collect()
    rows.sort(key=lambda r: (r.h, r.text))
    return train([r.text for r in rows], [[tuple(x) for x in r.found] for r in rows])


def personal_information(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, pieces): each text with its pieces (start, length, pii_type, pii_text), in order, not overlapping.

    start counts code points from 0.  NULL and empty texts have no pieces and stay as they are; a NULL key is kept;
    repeated rows give repeated results; texts of any length are read as a whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    narrow = spread(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))

    def run(batches):
        finder = Finder(shared.value)
        for batch in batches:
            text = flat.strings(batch.column(1))
            for a, b in flat.slices(text, flat.SLICE_CHARS // 2):
                part = text.slice(a, b - a)
                row, start, end, kind = finder.find(part)
                used = np.unique(row)
                values = dict(zip(used.tolist(), part.take(pa.array(used)).to_pylist(), strict=True))
                exact = [(r, x, y, settled_type(values[r][x:y], k)) for r, s, e, k in zip(row.tolist(), start.tolist(), end.tolist(), kind.tolist(), strict=True) for x, y in bounds(values[r], s, e, k, finder.model.names)]
                row, start, end, kind = np.array(exact, np.int64).reshape(-1, 4).T
                found = [values[r][x:y] for r, x, y, _ in exact]
                pieces = pa.StructArray.from_arrays(
                    [pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(np.array(TYPES, object)[kind], pa.string()), pa.array(found, pa.string())],
                    ["start", "length", "pii_type", "pii_text"],
                )
                offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(offsets, pieces)], ["key", "text", "pieces"])

    kind = narrow.schema["key"].dataType.simpleString()
    out = narrow.mapInArrow(run, f"key {kind}, text string, pieces array<struct<start: int, length: int, pii_type: string, pii_text: string>>")
    return out.withColumnRenamed("key", key)


def found_pieces(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pii_type, pii_text), each once for a document."""
    return marked.select(key, F.explode("pieces").alias("p")).select(key, "p.pii_type", "p.pii_text").distinct()


def redact(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, n_replaced): the texts with [PERSON_NAME], [EMAIL] and so on in place of their pieces; the rest is kept as it is."""
    cut = F.aggregate(
        "pieces",
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, p: F.struct(
            F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, p["start"] - acc["at"]), F.lit("["), F.upper(p["pii_type"]), F.lit("]")).alias("done"), (p["start"] + p["length"]).alias("at")
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return marked.select(key, F.when(F.size("pieces") == 0, F.col("text")).otherwise(cut).alias("text"), F.size("pieces").alias("n_replaced"))
