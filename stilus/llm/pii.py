"""Personal details inside free text (problem 5): found behind disguises, replaced in the source.

A text goes through transducers that undo disguises and keep, for every character of their output,
the span of source characters it came from: look-alike letters and invisible characters, spelled
digits, and at/dot disguises of addresses. Detection runs on the output; the spans found are mapped
back, so everything else of the source stays as it was.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.lookalike import INVISIBLE, LIGATURES, drawn_alike
from stilus.session import spread

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# Common given names of the languages in the corpus.
GIVEN_NAMES = """
adam adrian agnes albert alejandro alex alexander alexandra alfred alice alicia amelia ana andrea andreas andrew angela anita anna
anne anthony antonio arthur astrid barbara beatrice benjamin bernard birgit brian bruno camille carla carlos carmen carolina caroline
catherine cecilia charles charlotte chiara chloe christian christine claire clara claudia daniel daria david dennis diana diane diego
dominik dora edith eduardo edward elena elisa elisabeth elizabeth ella emil emily emma enrique eric erik eva fabian felix fernando
florian francesca francis francisco frank franz frederic gabriel george georg gerhard greta gustav hannah hans harry heinrich
helen helena helga henri henry hugo ida igor ingrid ines irene isabel isabelle jack jacques jakob james jan jane javier jean jennifer
joan joanna johannes john jonas jorge jose joseph juan judith julia julian julie karen karin karl kate katharina klaus laura lea leon
leonie liam lina linda lisa lorenzo louis louise lucas lucia luis luisa lukas madeleine manuel marc marcel marco margaret maria marie
marina mario marion mark markus marta martha martin martina mary mateo matthias max michael michel miguel mila monika nadia natalie
nicolas nina nora olga oliver olivia oscar otto pablo patricia patrick paul paula paulina pauline pedro peter petra philip pierre
rafael raquel rebecca renate ricardo richard robert roberto roland rosa ruth sabine samuel sandra sara sarah sebastian sergio silvia
simon sofia sonia sophia sophie stefan stephan stephen susan susanne sylvie teresa theo theodor thomas tobias ulrich ursula valerie
vera veronica victor victoria viktor vincent walter werner wilhelm william xavier yvonne zoe
""".split()
TITLES = "mr mrs ms miss mister dr prof professor sir madam herr frau doktor mme mlle madame monsieur señor señora señorita sr sra srta don doña signor signora".split()
#: Words after a given name or title that make it no person's surname.
NOT_SURNAMES = set("""
street road avenue lane close court drive terrace square place museum choir university school college hospital church park station lake
river bridge library theatre theater hotel club county city airport centre center institute foundation company prize award day
and or but the a an in on at of to for from with without was were is are has had have said says who whom that which this when while then
because before after under over near by as so not no never again always also und oder der die das den dem ein eine ist war hat in im am
mit von zu für auf aus et ou le la les un une de du des est était a au aux en dans avec pour par qui que y o el los las una es era con
por para del al lo se su
""".split())
_STREET_EN = r"(?:street|st|road|rd|avenue|ave|lane|ln|close|court|ct|drive|dr|terrace|way|place|pl|square|sq|boulevard|blvd|crescent|gardens|row|hill|parkway|highway|mews)"

_W = r"[^\W\d_]"  # a letter
EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9_](?:[\w.+%-]*[\w+%-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
ADDRESS = re.compile(
    rf"(?<![\w.,/-])(?:(?:flat|apt\.?|apartment|unit|suite)\s+\d+\w?,\s*)?\d{{1,5}}\s?[a-z]?,?\s+(?:(?:north|south|east|west|n|s|e|w)\.?\s+)?(?:{_W}[\w'’-]*\s+){{1,3}}{_STREET_EN}(?![\w-])\.?(?:,?\s*(?:flat|apt\.?|apartment|unit|suite)\s+\d+\w?)?"
    rf"|(?<![\w.,/-])\d{{1,4}}\s?(?:bis|ter|quater|[a-d])?,?\s+(?:rue|avenue|chemin|boulevard|place|allée|impasse|quai|route|cours|passage|square)\s+(?:(?:de|du|des|la|le|les)\s+|de\s+la\s+|d['’]|l['’])*{_W}[\w'’-]+(?: (?-i:[A-Z])[\w'’-]+)*"
    rf"|(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|camino|carretera|ronda|travesía|vía)\s+(?:(?:de|del|la|las|los|el)\s+)*{_W}[\w'’-]+(?:\s{_W}[\w'’-]+){{0,2}}?,?\s+(?:n[.º°o]*\s*)?\d{{1,4}}(?!\w)(?:,\s*\d{{1,2}}\s?[oºª°]?\s?[a-z]?(?!\w))?"
    rf"|(?<!\w){_W}+(?:str(?:aße|asse|\.)|weg|gasse|platz|allee|ufer|damm|ring|steig|pfad|chaussee)\s+\d{{1,4}}\s?[a-z]?(?!\w)"
    rf"|(?<!\w){_W}[\w-]+\s(?:straße|strasse|weg|gasse|platz|allee)\s+\d{{1,4}}\s?[a-z]?(?!\w)",
    re.I,
)
ID_NUMBER = re.compile(
    r"(?<![\w.,/+-])(?:"
    r"\d{3}([- ])\d{2}\1\d{4}"  # social security
    r"|[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d]"  # national insurance
    r"|[a-z]\d{3}-\d{4}-\d{4}|[a-z]\d{3}-\d{3}-\d{2}-\d{3}(?:-\d)?"  # licence
    r"|[a-z]{1,2}\d{7,8}"  # passport, identity card
    r"|\d{8}-?[a-z]|[xyz]-?\d{7}-?[a-z]"  # identity card, foreigner
    r"|[12][\s.]?\d{2}[\s.]?\d{2}[\s.]?\d{2}[\s.]?\d{3}[\s.]?\d{3}[\s.]?\d{2}"  # social security with key
    r"|\d{2} \d{3} \d{3} \d{3}"  # tax
    r")(?![\w/-])(?![.,]\d)",
    re.I,
)
#: A number introduced by what it is.
NAMED_ID = re.compile(
    r"(?<!\w)(?:social security|national insurance|insurance number|ssn|passport|driving licen[cs]e|driver'?s licen[cs]e|licen[cs]e number|tax (?:id|number)|id number|identity (?:card|number)|steuer-?id\w*|steuernummer|ausweis\w*|reisepass\w*|führerschein\w*|sozialversicherung\w*|sécurité sociale|n° de sécu|passeport|permis de conduire|carte d'identité|numéro fiscal|dni|nie|nif|pasaporte|número de identidad|seguridad social|carné)"
    r"(?:[^\w\n]|\s(?:no|number|nummer|numéro|número|n°|is|was|lautet|ist|war|est|es|era|der|de|del))*?\s*[:#]?\s*((?!(?:is|est|ist|es|no|de)\b)(?:[a-z]{1,3}[- ]?)?\d[\d .-]{4,18}\d(?:-?[a-z]\b)?)(?!\w)",
    re.I,
)
PHONE = re.compile(
    r"(?<![\w./,:+-])(?<!\d )(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,11}"
    r"|(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}|1?[2-9]\d{2}[2-9]\d{6}"
    r"|\(?0\d{2,4}\)?[ /.-]\d{3,8}(?:[ -]\d{2,6}){0,2}|0\d{9,10}"
    r"|0\d(?:[ .-]\d{2}){4}"
    r"|[6789]\d{2}(?:[ .-]\d{2}){3}|[679]\d{2}[ .-]\d{3}[ .-]\d{3}|[67]\d{8}"
    r")(?![\w/-])(?![.,]\d)(?! \d)"
)
_given = "|".join(sorted(GIVEN_NAMES, key=len, reverse=True))
_titles = "|".join(sorted(TITLES, key=len, reverse=True))
_SURNAME = rf"((?:(?:van|von|de|della|del|der|den|di|du|la|le|mc|mac|o['’])\s?)*{_W}[^\W\d_’']{{2,}}(?:['’-]{_W}{{2,}})*)"
NAME = re.compile(rf"(?<![\w@.+-])(?:(?:(?:{_titles})\.?\s+)*(?:{_given})(?:-(?:{_given}))?\s+(?:{_W}\.\s*|(?:{_given})\s+)*|(?:(?:{_titles})\.?|m\.)\s+(?:{_W}\.\s*)?){_SURNAME}(?![\w@])", re.I)
#: Ways to give a name, in small letters: what follows in capitals is one, whatever the name.
CUES = (
    "my name is", "my name's", "i am called", "i'm called", "call me", "full name:", "name:", "signed,", "signed by", "yours truly,", "sincerely,", "kind regards,", "best regards,",
    "je m'appelle", "je m’appelle", "mon nom est", "signé,", "ich heiße", "ich heisse", "mein name ist", "unterzeichnet,", "me llamo", "mi nombre es", "firmado,",
    "mi chiamo", "il mio nome è", "chamo-me", "o meu nome é", "ik heet", "mijn naam is",
)
_CUED = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, CUES))})\s+((?:{_W}[\w'’-]*\.?[^\S\n]+){{1,4}}{_W}[\w'’-]+)", re.I)
#: A word of each cue that plain text seldom has.
_CUE_WORDS = frozenset(_w.casefold() for _w in "name called call signed truly sincerely regards appelle nom signé heiße heisse unterzeichnet llamo nombre firmado chiamo nome chamo heet naam".split())
_PARTICLES = frozenset("van von der den de del della di da du le la zu ter ten bin ibn al el".split())
_STARTS = frozenset(GIVEN_NAMES) | frozenset(TITLES) | {"m"}
_LETTERS = re.compile(rf"{_W}+")

_COMPOUND = re.compile(rf"{_W}{{3,}}(?:str(?:aße|asse|\.)|weg|gasse|platz|allee|ufer|damm|ring|steig|pfad|chaussee)\s+\d", re.I)
_STREET_WORDS = frozenset(
    "street st road rd avenue ave lane ln close court ct drive dr terrace way place pl square sq boulevard blvd crescent gardens row hill parkway highway mews flat apt apartment unit suite bis ter quater rue chemin allée impasse quai route cours passage calle avenida avda plaza paseo camino carretera ronda travesía vía de du des del la le les los las el straße strasse weg gasse platz allee a b c d".split()
)
#: Words one of which every address has, unless its street's name ends like one.
_STREETS = frozenset(
    "street st road rd avenue ave lane ln close court ct drive dr terrace way place pl square sq boulevard blvd crescent gardens row hill parkway highway mews rue chemin allée impasse quai route cours passage calle avenida avda plaza paseo camino carretera ronda travesía vía weg gasse platz allee straße strasse".casefold().split()
)
_SUFFIX = re.compile(r"(?:str(?:aße|asse|\.)|weg|gasse|platz|allee|ufer|damm|ring|steig|pfad|chaussee)\s+\d", re.I)
#: Words that stand between a number and "drive", "close" or "way" in plain sentences.
_NO_STREET = frozenset("before after you we they he she it i me him her us them to and or but the this that these those can could will would may might must should did does do is are was were be been have has had not only very so too more most people minutes hours days weeks months years times miles on in at by from with without".split())

_DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    "oh": "0", "zwo": "2",
}
assert all(_w == _w.casefold() for _w in _DIGIT_WORDS)
_digit_word = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:(?:{_digit_word})(?:[\s,.-]+|$)){{6,}}(?:(?:{_digit_word})(?!\w))?|(?<!\w)(?:(?:{_digit_word})[\s,.-]+){{6,}}(?:{_digit_word})(?!\w)", re.I)
_DOT_BARE, _AT_BARE = "dot|punto|punkt|point|ponto", "arroba|ät|@"
_DOT_IN, _AT_IN = rf"{_DOT_BARE}|\.", rf"{_AT_BARE}|at|a|chez"  # in brackets
_DOT = rf"(?:\s*[\[({{<]\s*(?:{_DOT_IN})\s*[\])}}>]\s*|\s+(?:{_DOT_BARE})\s+)"
_AT = rf"(?:\s*[\[({{<]\s*(?:{_AT_IN})\s*[\])}}>]\s*|\s+(?:{_AT_BARE})\s+|@)"
_PART = r"[A-Za-z0-9](?:[A-Za-z0-9_+%-]*[A-Za-z0-9])?"
_LOCAL, _DOMAIN = rf"(?<![\w.+%-]){_PART}(?:(?:\.|{_DOT}){_PART}){{0,4}}", r"[A-Za-z0-9-]+"
DISGUISED = re.compile(rf"{_LOCAL}{_AT}{_DOMAIN}(?:(?:\.|{_DOT}){_DOMAIN}){{1,4}}", re.I)
#: A bare "at" counts only before a spelled dot.
LOOSE = re.compile(rf"{_LOCAL}\s+at\s+({_DOMAIN})(?:\.{_DOMAIN}){{0,3}}{_DOT}{_DOMAIN}(?:(?:\.|{_DOT}){_DOMAIN}){{0,3}}", re.I)
_TRIGGER = re.compile(rf"[\[({{<]\s*(?:{_AT_IN}|{_DOT_IN})\s*[\])}}>]|\s(?:{_AT_BARE}|{_DOT_BARE})\s", re.I)
#: The bare words that such a disguise is made of; otherwise it has a bracket or an @.
_DISGUISE_WORDS = frozenset(_w.casefold() for _w in f"{_DOT_BARE}|{_AT_BARE}".split("|") if _w != "@")
_ANY_DOT, _ANY_AT = re.compile(_DOT, re.I), re.compile(rf"{_AT}|\s+at\s+", re.I)
_HIDDEN = re.compile("[" + re.escape(INVISIBLE + "".join(LIGATURES)) + "̀-ͯ]")
_WIDE = re.compile(r" {2,}")
_DIGIT = re.compile(r"\d")
_SPELLED_START = re.compile(rf"(?<!\w)(?:{_digit_word})[\s,.-]+(?:{_digit_word})[\s,.-]+(?:{_digit_word})(?!\w)", re.I)


class Traced:
    """A text derived from a source, with the source span of each of its characters."""

    def __init__(self, source: str):
        self.text, self.start, self.end = source, None, None  # None: character i is source[i]
        self.words: list[str] = []

    def _spans(self) -> None:
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))

    def same_length(self, text: str) -> None:
        self.text = text

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Replace each match by to(match); each new character stands for the whole match."""
        matches = [(m, r) for m in pattern.finditer(self.text) if (r := to(m)) is not None]
        if not matches:
            return
        self._spans()
        text, start, end, at = [], [], [], 0
        for m, r in matches:
            a, b = m.span()
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            if b > a:
                text.append(r)
                start += [self.start[a]] * len(r)
                end += [self.end[b - 1]] * len(r)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start = start + self.start[at:]
        self.end = end + self.end[at:]

    def source_span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _accented(m: re.Match) -> str:
    c = m.group(0)
    return LIGATURES.get(c, "")


def _plain_address(m: re.Match) -> str | None:
    if m.re is LOOSE and m.group(1).lower() in NOT_SURNAMES:
        return None
    out = _ANY_AT.sub("@", _ANY_DOT.sub(".", m.group(0)), count=1)
    return out if EMAIL.fullmatch(out) else None


def _words(text: str) -> list[str]:
    """The runs of letters of a text, folded as patterns without regard to case match them."""
    return _LETTERS.findall(text.casefold().replace("ı", "i").replace("i̇", "i"))


def undisguise(text: str) -> Traced:
    """The text without disguises, traced to its source."""
    t = Traced(text)
    if not text.isascii():
        t.same_length(drawn_alike(text))
        if _HIDDEN.search(t.text):
            t.rewrite(_HIDDEN, _accented)
    if "  " in t.text:
        t.rewrite(_WIDE, lambda m: " ")
    t.words = _words(t.text)
    if (not _DISGUISE_WORDS.isdisjoint(t.words) or any(c in t.text for c in "@([{<")) and _TRIGGER.search(t.text):
        before = t.text
        t.rewrite(DISGUISED, _plain_address)
        t.rewrite(LOOSE, _plain_address)
        if t.text != before:
            t.words = _words(t.text)
    if sum(map(_DIGIT_WORDS.__contains__, t.words)) >= 3 and _SPELLED_START.search(t.text):
        t.rewrite(SPELLED, lambda m: "".join(_DIGIT_WORDS[w.lower()] for w in re.findall(_digit_word, m.group(0), re.I)) + (" " if m.group(0)[-1:].isspace() else ""))
        t.words = _words(t.text)
    return t


@lru_cache(4096)
def _start_of(starts: frozenset[str]) -> re.Pattern:
    return re.compile(rf"(?<![\w@.+-])(?:{'|'.join(sorted(starts, key=len, reverse=True))})(?!{_W})", re.I)


def _names(text: str, starts: frozenset[str]) -> Iterator[re.Match]:
    """The matches of NAME in a text, tried only where one of the starts that it has stands."""
    at = 0
    for w in _start_of(starts).finditer(text):
        if w.start() >= at and (m := NAME.match(text, w.start())):
            at = m.end()
            yield m


def _is_name(m: re.Match) -> bool:
    surname, whole = m.group(1), m.group(0)
    last = re.split(r"[\s]", surname)[-1]
    if last.lower() in NOT_SURNAMES or surname.lower() in NOT_SURNAMES or last.lower() in _STARTS:
        return False
    if whole.islower():
        # only in a text in small letters throughout, and there a title as a word of its own ("die frau
        # ging") is no evidence
        return m.string.islower() and len(last) >= 4 and not whole.startswith(("don ", "sir ", "frau ", "herr ", "m. ", "dr ", "sr "))
    return last[0].isupper() and whole[0].isupper()


def _cued_name(m: re.Match) -> tuple[int, int] | None:
    """The span of the two words in capitals after a cue, with at most initials and particles between
    them; None if there are fewer."""
    begin, end, seen = m.start(1), m.start(1), 0
    for w in re.finditer(rf"{_W}[\w'’-]*\.?", m.group(1)):
        word = w.group(0)
        if word[0].isupper() and word.rstrip(".").lower() not in NOT_SURNAMES:
            if len(word.rstrip(".")) == 1 and seen:
                continue
            seen += 1
            end = begin + w.end() - (word[-1] == "." and len(word) > 2)
            if seen == 2 or word[-1] == "." and len(word) > 2:
                break
        elif not seen or word.lower() not in _PARTICLES:
            break
    return (begin, end) if seen > 1 else None


def _is_address(m: re.Match) -> bool:
    """A street's name begins with a capital letter, unless the text has none around it."""
    words = re.findall(r"[^\W\d_][\w'’-]*", m.group(0))
    names = [w for w in words if w.lower() not in _STREET_WORDS]
    if not names:
        return False
    if any(w.lower() in _NO_STREET for w in names):
        return False
    return m.group(0).islower() or any(w[0].isupper() for w in names) or bool(_COMPOUND.search(m.group(0)))


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each detail, as spans of the source that don't overlap, in order."""
    t = undisguise(text)
    s = t.text
    found: list[tuple[int, int, str]] = []

    def claim(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    if "@" in s:
        for m in EMAIL.finditer(s):
            claim(*m.span(), "email")
    if _DIGIT.search(s):
        if not _STREETS.isdisjoint(t.words) or _SUFFIX.search(s):  # what every address has
            for m in ADDRESS.finditer(s):
                if _is_address(m):
                    claim(*m.span(), "street_address")
        for m in ID_NUMBER.finditer(s):
            claim(*m.span(), "id_number")
        for m in NAMED_ID.finditer(s):
            claim(*m.span(1), "id_number")
        for m in PHONE.finditer(s):
            claim(*m.span(), "phone")
    if starts := _STARTS.intersection(t.words):
        for m in _names(s, starts):
            if _is_name(m):
                claim(*m.span(), "person_name")
    if not _CUE_WORDS.isdisjoint(t.words):
        for m in _CUED.finditer(s):
            if span := _cued_name(m):
                claim(*span, "person_name")
    found.sort()
    return [(*t.source_span(a, b), k) for a, b, k in found]


def redact(text: str) -> tuple[str, list[str]]:
    """`text` with each detail replaced by a placeholder of its kind, and the kinds, sorted."""
    out, at, kinds = [], 0, set()
    for a, b, kind in find(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
        kinds.add(kind)
    return "".join(out) + text[at:], sorted(kinds)


def redact_table(texts: DataFrame, key: str, text: str, field: str, with_text: bool = True) -> DataFrame:
    """(field, rec_id, kinds ARRAY<STRING>[, redacted STRING]) of every record.

    Null text: kinds empty, redacted null. Repeated rows stay repeated; extra columns are ignored;
    texts are taken whole, whatever their length. An empty table gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [redact(t) if t is not None else (None, []) for t in batch["__t"]]
            out = pd.DataFrame({"field": field, "rec_id": batch["rec_id"], "kinds": [k for _, k in done]})
            yield out.assign(redacted=[r for r, _ in done]) if with_text else out

    rows = spread(texts.select(F.col(key).cast("long").alias("rec_id"), F.col(text).alias("__t")))
    return rows.mapInPandas(run, "field string, rec_id long, kinds array<string>" + (", redacted string" if with_text else ""))


def kinds_found(texts: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(field, rec_id, pii_kind): each kind found in a record, once."""
    return redact_table(texts, key, text, field, with_text=False).select("field", "rec_id", F.explode("kinds").alias("pii_kind")).distinct()
