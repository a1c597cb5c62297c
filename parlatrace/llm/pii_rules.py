"""Finding personal data in the text of an HTML document: what it looks like, and what stands around it.

Names written with capitals are found by the model in name_model, whatever the sentence; names in lower case, and single initials, by
the phrases below that present, address or point at a person.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass

from parlatrace.llm.name_model import GIVEN_NAMES, NO_PERSONS, PARTICLES, names_in, word_class

# Words that no name, and no street name, is made of.
FUNCTION_WORDS = frozenset(
    """a an the this that these those it its he him his she her hers they them their theirs we us our ours you your yours i me my mine who whom whose which what when where why how
    and or but nor so if because while since until than as of in on at by for from to into onto out off up down over under about after before behind between with without within near next
    is are was were be been being am do does did done has have had having can could will would shall should may might must not no yes nobody everybody everyone someone anyone somebody anybody nothing everything something
    all both each every either neither some any many much more most few other others another such same only just even also too very still already later then there here now again always never often once twice soon
    one two three four five six seven eight nine ten first second third last new old please thanks good morning evening honestly today tomorrow yesterday monday tuesday wednesday thursday friday saturday sunday
    someone's people person man woman men women guy team colleague colleagues neighbour neighbours volunteer volunteers doctor doctors mother father boss friend friends visitor visitors children manager driver
    der die das den dem des ein eine einen einem einer eines ich du er sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen mein meine dein sein seine unser und oder aber denn weil dass ob wenn als wie wo was wer wen wem
    in im an am auf aus bei mit nach von vom zu zum zur über unter vor hinter neben zwischen durch für gegen ohne um nicht kein keine auch nur noch schon immer nie mal da dort hier jetzt dann damals danach bitte danke
    ist sind war waren wird werden hat haben hatte kann können muss müssen soll niemand jemand alle alles etwas nichts man viele kollegen kollegin nachbar frau herr
    el la los las un una unos unas lo al del de y e o u que quien cual donde cuando como por para con sin sobre entre hasta desde en a yo tú él ella nosotros ellos ellas usted ustedes me te se nos le les su sus mi mis tu tus
    no sí ni muy más ya también es son era fue está están hay ha han había nadie alguien todo todos todas nada algo señor señora don doña vecino vecina""".split()
)
# Nouns that make what stands before them the name of a place, a firm or a thing.
PLACE_NOUNS = "station|bridge|catalogue|catalog|street|road|depot|harbour|airport|hospital|school|church|hotel|museum|valley|river|lake|island|county|university|company|ltd|inc|gmbh|brand|model|magazine|newspaper|line|avenue|square|bahnhof|brücke|platz|puente|estación"
NUMBER_WORDS = "zero|oh|o|one|two|three|four|five|six|seven|eight|nine|double|triple|plus|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|doble|más"
SMALL_NUMBERS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
ENDINGS = "example|test|invalid|localhost|com|org|net|edu|gov|int|info|biz|name|app|dev|io|co|eu|uk|us|ca|au|nz|ie|de|at|ch|fr|es|pt|it|nl|be|se|dk|no|fi|pl|cz|ru|ua|jp|cn|in|br|mx|ar"
STREETS = "street|str|st|road|rd|avenue|ave|lane|ln|close|crescent|terrace|gardens|garden|row|yard|hill|quay|drive|dr|court|ct|place|square|way|park|mews|walk|grove|boulevard|blvd|parade|rise|view|green|wharf"
SOUND_WORDS = r"(?:u+h+m*|u+m+|e+r+m*|a+h+|h+m+|m+h+m+|m{2,}|m+-h+m+|u+h+-h+u+h+|h+u+h|h+u+m+|ä+h+m*|ö+h+m*|e+h+m*|e+u+h+|h+e+u+|ø+h+m*)"

_PIECE = re.compile(r"<!--.*?-->|<(style|script)\b[^>]*>.*?</\1\s*>|<[^>]+>|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", re.S | re.I)
_BREAKS = re.compile(r"</?(?:a|p|div|li|ul|ol|tr|td|th|table|h[1-6]|br|pre|body|head|html|meta|title|strong)\b", re.I)
_INVISIBLE = re.compile("[​-‏­⁠﻿]")
_NOISE = re.compile(rf"(?<![\w@.+'’-]){SOUND_WORDS}(?:\.\.\.|[,…])?(?:[ \xa0]+(?=\S)|$)|\[[^\[\]\n]{{0,60}}\][ \xa0]?|\(\([^()\n]*\)\)[ \xa0]?|\{{[^{{}}\n]*\}}[ \xa0]?|\*[^*\n]{{1,60}}\*[ \xa0]?|♪[^♪\n]*♪[ \xa0]?", re.I)


class Plain:
    """The text of an HTML document outside tags, with the place of each character in the source.

    References are decoded, invisible characters and inline tags dropped, blocks put on lines of their own; hesitation sounds and
    bracketed remarks are dropped too, since they may stand within a number or a name.
    """

    def __init__(self, source: str) -> None:
        parts: list[str] = []
        self.at: list[int] = []  # where a run begins in the text
        self.raw: list[int] = []  # and in the source; a run goes on in step with it
        n, end = 0, 0

        def add(text: str, start: int) -> None:
            nonlocal n
            if text:
                parts.append(text)
                self.at.append(n)
                self.raw.append(start)
                n += len(text)

        for m in _PIECE.finditer(source):
            add(source[end : m.start()], end)
            piece = m[0]
            if piece[0] == "<":
                if _BREAKS.match(piece):
                    add("\n", m.start())
            else:
                add(html.unescape(piece).replace("\n", " "), m.start())
            end = m.end()
        add(source[end:], end)
        whole = "".join(parts).replace("\xa0", " ")
        self.text = self._without(self._without(whole, _INVISIBLE), _NOISE)

    def _without(self, text: str, pattern: re.Pattern) -> str:
        spans = [m.span() for m in pattern.finditer(text)]
        if not spans:
            return text
        at, raw, parts, shift, end = [], [], [], 0, 0
        k = 0
        for a, b in [*spans, (len(text), len(text))]:
            if a > end:
                parts.append(text[end:a])
                while k < len(self.at) and self.at[k] <= end:
                    k += 1
                at.append(end - shift)
                raw.append(self.raw[k - 1] + end - self.at[k - 1])
                while k < len(self.at) and self.at[k] < a:
                    at.append(self.at[k] - shift)
                    raw.append(self.raw[k])
                    k += 1
            shift += b - a
            end = b
        self.at, self.raw = at, raw
        return "".join(parts)

    def place(self, position: int) -> int:
        k = bisect_right(self.at, position) - 1
        return self.raw[k] + position - self.at[k]


# ---- mail addresses

_JOIN = r"(?:\s+(?:underscore|unterstrich|guion bajo|dash|hyphen|minus|plus|bindestrich)\s+)"
_LOCAL = rf"[^\W_](?:[\w.+-]*[\w+-])?(?:{_JOIN}[\w+-]+){{0,3}}"
_LABEL = rf"[^\W_](?:[\w-]*[^\W_])?(?:{_JOIN}[^\W_](?:[\w-]*[^\W_])?){{0,2}}"
_DOT = r"(?:\s*\(dot\)\s*|\s*\[dot\]\s*|\s+dot\s+|\s+punkt\s+|\s+punto\s+|\.)"
_AT = r"(?:\s*\(at\)\s*|\s*\[at\]\s*|\s+at\s+|\s+arroba\s+|\s+ät\s+|\s?@\s?)"
_MAIL = re.compile(rf"(?<![\w@.+])(?:{_LOCAL}{_DOT}){{0,3}}{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}(?:{ENDINGS})(?![\w@-])", re.I)

#: What a mail address, or a street with its number, can't be without; the longer patterns are tried around it only.
_MAIL_SIGN = re.compile(r"@|[(\[]at[)\]]|\bat\b(?=\s+\S+(?:\s+\S+){0,4}?\s*(?:\b(?:dot|punkt|punto)\b|[(\[]dot|\.\w))|\barroba\b|\bät\b", re.I)
_STREET_SUFFIXES = tuple("straße strasse str. gasse allee weg platz ufer damm ring steig pfad straat laan plein gracht kade gatan vägen gade vej".split())
_BEFORE_NUMBER = re.compile(r"(?<=[^\W\d]) \d|(?<=\.) \d")


def _street_signs(text: str) -> list[tuple[int, int]]:
    """Where a number follows a word that ends like a street's name."""
    return [m.span() for m in _BEFORE_NUMBER.finditer(text) if text[max(0, m.start() - 8) : m.start()].lower().endswith(_STREET_SUFFIXES)]


def _around(pattern: re.Pattern, signs: list[tuple[int, int]], text: str, before: int, after: int) -> list[re.Match]:
    """Matches of pattern that cover one of the signs, of a length that is bounded on both sides of it."""
    found, end = [], 0
    for a, b in signs:
        if a < end:
            continue
        at = max(end, a - before)
        while (x := pattern.search(text, at, min(len(text), b + after))) and x.end() <= a:
            at = x.end()
        if x and x.start() <= a:
            found.append(x)
            end = x.end()
    return found


# ---- numbers

_PHONES = [
    r"\+\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,4}\) ?)?\d[\d ./-]{5,13}\d",
    r"00[1-9]\d{0,2} ?\(?\d{1,4}\)?[ .-]?\d[\d ./-]{4,11}\d",
    r"\(0\d{1,5}\) ?\d[\d -]{3,9}\d",
    r"0\d{1,4}[ /.-]\d[\d ./-]{4,10}\d",
    r"0\d{8,11}",
    r"(?:1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-]?)[2-9]\d\d[ .-]?\d{4}",
]
_IDS = [
    r"\d{3}[ -]\d{2}[ -]\d{4}",
    r"\d{2} \d{3} \d{3} \d{3}",
    r"\d{2,3}/\d{3,4}/\d{4,5}",
    r"[a-z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[a-d]",
    r"(?=[a-z0-9]{8,11}(?![a-z0-9]))(?=(?:[a-z]*\d){4})(?=(?:\d*[a-z]){2})[a-z][a-z0-9]*\d[a-z0-9]*",
    r"\d{8}[ -]?[a-z]",
    r"\d{9}|\d{11}",
]
_EDGES = r"(?<![\w@#/+.-])(?<![\d,]\.)", r"(?![\w@])(?![-/.]\w)"
_NUMBER = re.compile(rf"{_EDGES[0]}(?:(?P<phone>{'|'.join(_PHONES)})|(?P<id>{'|'.join(_IDS)})){_EDGES[1]}", re.I)
_SPOKEN = re.compile(rf"\b(?:{NUMBER_WORDS})(?:[ ,-]+(?:{NUMBER_WORDS})){{6,}}\b", re.I)
_ID_CUE = re.compile(r"(?:tax|passport|insurance|identity|social|security|licen[cs]e|\bid\b|\bcard\b|steuer|ausweis|versicherung|\bpass\b|identidad|\bdni\b|\bnif\b|pasaporte|seguro|fiscal|impôt|passeport|stamped)", re.I)
_PHONE_CUE = re.compile(r"(?:call|ring|phone|mobile|cell|dial|engaged|direct line|\bline\b|urgent|reach|rufen|anrufen|telefon|handy|nummer lautet|llám|llame|teléfono|móvil|appel|téléphone)", re.I)
_OTHER_CUE = re.compile(r"\b(?:invoice|ticket|version|order|units|room|gate|rechnung|auftrag|factura|pedido|build|serial|article|item)\b\W{0,3}(?:\w+\W+){0,3}$", re.I)

# ---- addresses

_NUM = r"\d{1,4} ?[a-d]?(?![\w:.]*\d)(?!\w)"
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_ADDRESSES = [
    re.compile(rf"(?<![\w/.-])(?:(?:flat|apartment|apt|unit|suite)\.? \d{{1,4}}[a-z]?,? )?(?P<no>\d{{1,4}}[a-d]?|{SMALL_NUMBERS}) (?P<name>{_WORD}(?: {_WORD}){{0,2}}) (?:{STREETS})\b\.?(?:,? (?:apartment|apt|flat|unit)\.? \d{{1,4}}[a-z]?)?", re.I),
    re.compile(rf"(?<![\w-])(?P<name>(?:(?:große|kleine|alte|neue|obere|untere|lange|kurze|hohe|breite|hintere|vordere)[rns]? )?(?:{_WORD}(?:straße|strasse|gasse|allee|weg|platz|ufer|damm|ring|steig|pfad)|{_WORD}[ -](?:straße|strasse|str\.|gasse|allee|weg|platz|ufer|damm|ring|steig|pfad))) {_NUM}", re.I),
    re.compile(rf"(?<![\w-])(?P<name>(?:am|im|an der|auf der|auf dem|zum|zur|unter den|in den) {_WORD}(?: {_WORD})?) {_NUM}(?! (?:uhr|jahr|prozent|euro))", re.I),
    re.compile(rf"(?<![\w-])(?P<name>(?:calle|avenida|avda\.?|plaza|paseo|camino|ronda|travesía|rua|praça|travessa|via|viale|piazza|corso|vicolo) (?:(?:de la|de los|de las|del|de|da|do|dos|das|della|dei) )?{_WORD}(?: {_WORD})?),? (?:(?:número|núm\.?|n\.?º|numero|n\.) ?)?{_NUM}", re.I),
    re.compile(rf"(?<![\w/.-])\d{{1,4}}(?: bis)?,? (?P<name>(?:rue|boulevard|chemin|impasse|quai|allée) (?:(?:de la|de l['’]|des|du|de|d['’]) ?)?{_WORD}(?: {_WORD})?)", re.I),
    re.compile(rf"(?<![\w-])(?P<name>{_WORD}(?:straat|laan|plein|gracht|kade|gatan|vägen|gade|vej)) {_NUM}", re.I),
]

# ---- persons

_PART = r"(?:[^\W\d_]\.(?=[ \n])|[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*)"
_ONE = rf"{_PART}(?: {_PART}){{0,3}}?"
_START = r"(?:^|[\n.!?…:;\"»)/>]|(?<=\s)-(?=\s)|(?<=:\d\d)) *"
_END = r"(?=\s*(?:[.,;:!?…\n/]|$))"
_TITLE = r"(?:doctor|dr\.?|mr\.?|mrs\.?|ms\.?|miss|professor|prof\.?|sir|madam|herr|herrn|frau|fräulein|señora?|señorita|sr\.?a?\.?|don|doña|madame|monsieur|mme|signora?|dottoress?a?|senhora?|mevrouw|meneer|fru)"
_KIN = r"(?:neighbou?r|colleague|boss|uncle|aunt|cousin|brother|sister|friend|wife|husband|son|daughter|nachbar(?:in)?|kollege|kollegin|chef(?:in)?|onkel|tante|bruder|schwester|vecin[oa]|herman[oa]|ti[oa]|prim[oa]|jef[ea]|voisine?|collègue)"
_DOES = r"(?:signed|took over|takes over|saw|said|says|asked|told|wrote|called|agreed|answered|replied|explained|mentioned|thinks|hat|hatte|sagte|meinte|fragte|unterschrieb|firmó|dijo|dice|preguntó|llamó|escribió|a dit|a signé)"
#: Patterns, each with the words it may begin with, in lower case: they are tried where one of these stands.
_PERSONS = [
    (re.compile(p, re.I), begin.split())
    for p, begin in (
        # presented or addressed
        (rf"\b(?:interview|talk|conversation|meeting|gespräch|entrevista|entretien) (?:with|mit|con|a|avec) (?P<n>{_ONE}){_END}", "interview talk conversation meeting gespräch entrevista entretien"),
        (rf"\b(?:thanks|thank you|danke|gracias|merci|hello|hallo|hola)(?:,| )+(?P<n>{_ONE}){_END}", "thanks thank danke gracias merci hello hallo hola"),
        (rf"\b(?:speaking is|my name is|this is|here is|i am called|ich heiße|mein name ist|hier spricht|me llamo|mi nombre es|je m['’]appelle) (?P<n>{_ONE})(?=,| (?:speaking|good|from|and)\b|\s*[.!?\n]|$)", "speaking my this here i ich mein hier me mi je"),
        # titles and relations
        (rf"\b{_TITLE} (?P<n>{_ONE})(?= {_DOES}\b|['’]s\b| (?:is|was|has|will|can|ist|war|wird|es|fue|está|and|und|y)\b|\s*[.,;:!?\n]|$)", "doctor dr mr mrs ms miss professor prof sir madam herr herrn frau fräulein señor señora señorita sr sra don doña madame monsieur mme signor signora dottores dottoressa dottoresa senhor senhora mevrouw meneer fru"),
        (rf"\b(?:my|our|your|his|her|their|mein|meine|meiner|unser|unsere|mi|su|nuestr[oa]|mon|ma) {_KIN} (?P<n>{_ONE})(?= {_DOES}\b|['’]s\b| (?:is|was|has|ist|war|es|fue)\b|\s*[.,;:!?\n]|$)", "my our your his her their mein meine meiner unser unsere mi su nuestro nuestra mon ma"),
        # pointed at
        (rf"\b(?:that|it|this) (?:was|is) (?P<n>{_ONE})(?= on the (?:line|phone)\b|['’]s (?:idea|fault|turn|plan|job|suggestion|decision|voice|number|key|desk)\b| (?:who|again)\b)", "that it this"),
        (rf"\bdas (?:war|ist)(?: damals| doch| wohl| also)* (?P<n>{_ONE})(?=,? (?:wenn|falls|glaube|oder)\b| am (?:telefon|apparat)\b)", "das"),
        (rf"\b(?:era|fue) (?P<n>{_ONE})(?= (?:al|quien)\b)", "era fue"),
        # asked, told
        (rf"\b(?:i|we|he|she|they|you) (?:have |had )?(?:asked|told|called|met|thanked|warned|phoned|invited|rang) (?P<n>{_ONE})(?= (?:about|to|for|if|whether|that|yesterday|again)\b|\s*[.!?\n]|$)", "i we he she they you"),
        (rf"\b(?:ich|wir|er|sie) (?:habe|haben|hat) (?P<n>{_ONE})(?= (?:danach |das |schon |gestern )?(?:gefragt|angerufen|getroffen|gebeten|gesehen|eingeladen)\b)", "ich wir er sie"),
        (rf"\ble (?:pregunté|dije|pedí|conté) a (?P<n>{_ONE})(?= (?:y|que|si|por)\b|\s*[.,!?\n]|$)", "le"),
        # doing
        (rf"\b(?:later|then|afterwards|finally|yesterday),? (?P<n>{_ONE})(?= {_DOES}\b)", "later then afterwards finally yesterday"),
        (rf"\b(?:nobody|no one|everyone|everybody|anyone|niemand|nadie|todos) (?:but|except|außer|salvo|menos) (?P<n>{_ONE})(?= (?:had|has|knew|knows|was|came|hatte|tenía|sabía)\b|\s*[.,!?\n]|$)", "nobody no everyone everybody anyone niemand nadie todos"),
        (rf"\b(?:we|they|i) had (?P<n>{_ONE})(?= in the (?:room|office|house|studio|meeting)\b)", "we they i"),
        (rf"\band (?:later|then|afterwards|also) (?P<n>{_ONE})(?=\s*[.!?\n/]|$)", "and"),
    )
]
#: Patterns that begin with the name itself, each with what stands behind it: they are tried around that.
_LED_BY_NAME = [
    (re.compile(rf"{_START}{name}(?={tail})", re.I), re.compile(rf"(?<=[\w.])(?={sign})", re.I))
    for name, tail, sign in (
        (rf"(?P<n>{_ONE})", *[r", (?:could|can|would|will|please|do you|kannst|können|könnten|puede|podría|pourriez)\b"] * 2),
        (rf"(?P<n>{_ONE})", *[rf" {_DOES} (?:the|it|us|me|that|over|das|la|el)\b"] * 2),
        (rf"(?P<n>{_ONE}) and (?P<m>{_ONE})", *[r" (?:were|are|have|had) both\b"] * 2),
    )
]
#: In text without punctuation a name at a sentence's edge is bounded on one side only; on the other it goes on as long as the words aren't frequent ones.
_OPEN_RIGHT = re.compile(r"\b(?:thanks|thank you|danke|gracias|and later|and then|interview with) (?=\S)", re.I)
_OPEN_LEFT = re.compile(rf" (?:(?:could|can|would|will) you\b|and (?P<m>{_ONE}) (?:were|are|have|had) both\b)", re.I)
_LINE_HEAD = re.compile(r"^(?:\s*[\[(]?(?:\d{1,3}:\d\d(?::\d\d)?(?:\.\d+)?|(?://)?\[?(?:speaker|spk|sprecher(?:in)?|hablante|s)[\s_.-]?\w+\]?(?=\s*[-:>(\[]))[\])]?\s*[-:>]*)+\s*", re.I)
_WORDS = re.compile(r"\S+")
_ARTICLES = frozenset("a an the this that these those der die das den dem des ein eine einen einem einer el la los las un una".split())
_PLACE_AFTER = re.compile(rf"\s+(?:{PLACE_NOUNS})\b", re.I)


@dataclass(frozen=True)
class Mention:
    kind: str
    start: int  # in the source
    end: int  # in the source, behind the last character
    value: str  # as it reads


def _named(text: str) -> bool:
    """Whether words may be a person's name: none is a function word, and they aren't just a loose letter."""
    parts = text.split()
    if any(p.lower().strip(".") in FUNCTION_WORDS and not (0 < i < len(parts) - 1 and p in PARTICLES) for i, p in enumerate(parts) if len(p.strip(".")) > 1):
        return False
    if any(len(p) == 1 and (p.lower() in "aiyoeu" or len(parts) == 1) and p.islower() and len(parts) == 1 for p in parts):
        return False
    return all(len(p.strip(".")) > 1 or p.endswith(".") or len(parts) > 1 or p.isupper() for p in parts)


def _caseless(text: str, position: int) -> bool:
    """Whether the line of a position has no capitals but those of its head (time and label)."""
    line = text[text.rfind("\n", 0, position) + 1 : (text.find("\n", position) + 1 or len(text) + 1) - 1]
    head = _LINE_HEAD.match(line)
    return line[head.end() if head else 0 :].islower()


def _name_length(words: list[str], back: bool, beyond: list[str]) -> int:
    """How many of the words, in order from the bounded edge of a name, belong to it. beyond: the word next to each in reading order (before it if back, else behind it)."""

    def letter(w: str) -> bool:
        return len(w) == 1 and w.isalpha()

    def may(k: int) -> bool:
        w = words[k]
        if not w.isalpha():
            return len(w) > 2 and bool(re.fullmatch(_PART, w))
        if w in FUNCTION_WORDS or letter(w):
            return False
        if beyond[k] in _ARTICLES and (back or k == 0) or not back and _PLACE_AFTER.match(" " + beyond[k]):
            return False  # 'in the dale', 'mark the date', 'brackworth station'
        return w in GIVEN_NAMES or word_class(w) != "common" and w not in NO_PERSONS

    n = k = 0
    while k < min(len(words), 3):
        w = words[k]
        if may(k):
            n = k + 1
        elif not letter(w):
            break
        elif w not in FUNCTION_WORDS and (back and n or word_class(w) != "common"):
            n = k + 1  # an initial before what is a name already
        elif not (k + 1 < min(len(words), 3) and may(k + 1)) or w in FUNCTION_WORDS and not n:
            break  # a letter counts between two words of a name, or as an initial before one
        k += 1
    return n


def _edges(text: str) -> list[tuple[str, int, list[re.Match], re.Match]]:
    """(line, its place, words from the known edge, pattern found) where a name in a line without case and punctuation has one open edge."""
    found = []
    for line in re.finditer(r"[^\n]+", text):
        head = _LINE_HEAD.match(line[0])
        skip = head.end() if head else 0
        s, at = line[0][skip:], line.start() + skip
        if not s.islower():
            continue
        for m in _OPEN_RIGHT.finditer(s):
            found.append((s, at, list(_WORDS.finditer(s, m.end(), min(len(s), m.end() + 120))), m))
        for m in _OPEN_LEFT.finditer(s):
            found.append((s, at, list(_WORDS.finditer(s, max(0, m.start() - 80), m.start()))[::-1], m))
    return found


def _unbounded(text: str) -> list[tuple[int, int]]:
    """Spans of names in lines without case and punctuation, where a name's one edge is told by the words themselves.

    A common word ends the name unless it is a given name and isn't next to an article. Initials go with their name.
    """
    found = []
    for _, at, words, m in _edges(text):
        if m.re is _OPEN_RIGHT:
            stop = next((k + 1 for k, w in enumerate(words) if w[0][-1] in "./"), len(words))
            bare = [w[0].strip("./") for w in words]
            n = _name_length(bare[:stop], False, [*bare[1:stop], "", ""])
            if n:
                last = words[n - 1]
                found.append((at + m.end(), at + last.start() + len(last[0].rstrip("./"))))
        else:
            bare = [w[0] for w in words]
            n = _name_length(bare, True, [*bare[1:], ""])
            if n:
                found.append((at + words[n - 1].start(), at + m.start()))
            if m["m"] and _named(m["m"]):
                found.append((at + m.start("m"), at + m.end("m")))
    return found


_PERSONS_AT = [p for p, _ in _PERSONS]
#: Word to the patterns that may begin with it.
_BEGINNING: dict[str, list[re.Pattern]] = {}
for _pattern, _begin in [
    *_PERSONS, (_SPOKEN, NUMBER_WORDS.split("|")), (_ADDRESSES[2], "am im an auf zum zur unter in".split()),
    (_ADDRESSES[3], "calle avenida avda plaza paseo camino ronda travesía rua praça travessa via viale piazza corso vicolo".split()),
]:
    for _word in _begin:
        _BEGINNING.setdefault(_word, []).append(_pattern)
_LETTERS = re.compile(r"[^\W\d_]+")


def _anchored(text: str) -> dict[re.Pattern, list[re.Match]]:
    """The matches of the patterns that begin with a known word, left to right, none within another: one scan for all of them."""
    found: dict[re.Pattern, list[re.Match]] = {p: [] for p in (*_PERSONS_AT, _SPOKEN, _ADDRESSES[2], _ADDRESSES[3])}
    for word in _LETTERS.finditer(text):
        for pattern in _BEGINNING.get(word[0].lower(), ()):
            before = found[pattern]
            if (not before or before[-1].end() <= word.start()) and (m := pattern.match(text, word.start())):
                before.append(m)
    return found


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def _number_kind(text: str, a: int, b: int, kind: str | None, count: int) -> str | None:
    before, after = text[max(0, a - 45) : a].rpartition("\n")[2], text[b : b + 35].partition("\n")[0]
    # the cue is looked for in the sentence the number stands in, or in a question just before it
    before = "" if re.search(r"[.!…] +$", before) else re.split(r"[.!?…] +(?=\S)", before)[-1]
    if _OTHER_CUE.search(before):
        return None
    ids, phones = bool(_ID_CUE.search(before) or re.match(r"\W*(?:was|is) what they stamped", after, re.I)), bool(_PHONE_CUE.search(before) or re.match(r"\W*(?:is )?(?:always |the )?(?:engaged|direct|busy)", after, re.I))
    if ids != phones:
        return "id_number" if ids else "phone"
    return kind or ("id_number" if count in (9, 11) else "phone")


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a plain text, in order, none within another. Nothing but the text decides."""
    found: list[tuple[int, str, int, int]] = []
    found += [(0, "email", m.start(), m.end()) for m in _around(_MAIL, [m.span() for m in _MAIL_SIGN.finditer(text)], text, 120, 200)]
    at = _anchored(text)
    street_signs = _street_signs(text)
    for pattern in _ADDRESSES:
        by_sign = pattern in (_ADDRESSES[1], _ADDRESSES[5])
        for m in _around(pattern, street_signs, text, 60, 12) if by_sign else at[pattern] if pattern in at else pattern.finditer(text):
            name = [w.lower() for w in m["name"].split()]
            street = name[1:] if pattern is not _ADDRESSES[0] else name
            if pattern is _ADDRESSES[0] and any(w in FUNCTION_WORDS and w not in ("old", "new", "first", "second", "third") for w in street):
                continue
            if pattern is _ADDRESSES[0] and not m["no"][0].isdigit() and m["name"].islower() and not _caseless(text, m.start()):
                continue
            if pattern is _ADDRESSES[1] and len(name) > 1 and name[-2] in FUNCTION_WORDS:
                continue
            found.append((1, "address", m.start(), m.end()))
    for m in _NUMBER.finditer(text):
        kind = _number_kind(text, m.start(), m.end(), "phone" if m["phone"] else "id_number", _digits(m[0]))
        if kind:
            found.append((2, kind, m.start(), m.end()))
    for m in at[_SPOKEN]:
        words = m[0].lower().replace(",", " ").replace("-", " ").split()
        count = len([w for w in words if w not in ("double", "triple", "doble", "plus", "más")])
        kind = _number_kind(text, m.start(), m.end(), None, count)
        if kind:
            found.append((2, kind, m.start(), m.end()))
    for m in [m for p in _PERSONS_AT for m in at[p]] + [m for p, sign in _LED_BY_NAME for m in _around(p, [(x.start() - 1, x.start()) for x in sign.finditer(text)], text, 160, 40)]:
        for g in ("n", "m") if "m" in m.re.groupindex else ("n",):
            a, b = m.span(g)
            if text[a].isupper():  # what is written small behind a name with a capital goes on with the sentence
                while (k := text.rfind(" ", a, b)) > 0 and text[k + 1 : b].islower() and word_class(text[k + 1 : b]) == "common":
                    b = k
            if _named(text[a:b]) and not _PLACE_AFTER.match(text, b):
                found.append((3, "name", a, b))
    found += [(4, "name", a, b) for a, b in _unbounded(text)]
    found += [(5, "name", a, b) for a, b in names_in(text) if _named(text[a:b]) and not _PLACE_AFTER.match(text, b)]
    found.sort(key=lambda x: (x[0], x[2] - x[3], x[2]))
    taken: list[tuple[str, int, int]] = []
    for _, kind, a, b in found:
        if all(b <= c or a >= d for _, c, d in taken):
            taken.append((kind, a, b))
    return sorted(taken, key=lambda x: x[1])


def mentions(source: str | None) -> list[Mention]:
    """The personal data in an HTML document; null and empty sources have none."""
    if not source:
        return []
    plain = Plain(source)
    return [Mention(kind, plain.place(a), plain.place(b - 1) + 1, plain.text[a:b]) for kind, a, b in spans(plain.text)]
