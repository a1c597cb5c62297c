"""Which capitalised words are a person's name: a linear model over the words and what stands around them.

The model is fitted once per process on the sentences in name_examples (a bounded, fixed sample; nothing of it depends on the tables a
query reads, so a transcript gets the same names alone and among millions). Evidence of single words comes from a public
tokenizer's vocabulary: a word that has a token of its own in lower case is a common one, one that has it with a capital only is mostly a
name (or, in German, a noun), and one without any is rare.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

from parlatrace.llm.name_examples import EXAMPLES
from parlatrace.llm.tokens import VOCABULARY

#: Vocabulary files whose tokens are the evidence of words; parameters of word_class.
VOCABULARIES = (VOCABULARY, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Given names that are common in the languages of the transcripts, in order.
GIVEN_NAMES = frozenset(
    """adam ahmed alan alberto alejandro alexander alice amy ana anders andrea andreas andrew andrzej anita anke ann anna anne antonio barbara beatriz ben bernd birgit bob carla carlos carmen caroline catherine charles charlotte chris
    christine claire claudia daniel dave david dieter dmitri dale elena elisabeth elizabeth emily emma erik eva ewa felix fernando frank françois gabriel george giovanni giulia grace greta hans harry heath heike helen henrik ian
    ingrid irina isabel ivan ivy jack jacques james jan jane javier jean jens joana joanna johan johannes john jorge josé juan julia julie jürgen karen karin karl katarzyna kate klaus lars laura lena leon linda lisa luca
    lucía luis lukas manuel marco margaret maria marie mario mark markus marta martin mary matthew mette michael michał miguel mohammed monika nick nicole oliver olga pablo paola patricia paul paula pedro per peter petra philip
    pierre piotr rachel rafael ralf richard robert rosa ruth sabine sally sam sandra sara sergei simon sofia sophie stefan stephen steve susan sven tatiana teresa thomas tim tom tomasz ulrike ursula vera victor walter werner william wolfgang""".split()
)
# Days, months, languages and peoples, countries and large cities, which are written with a capital and are no persons.
NO_PERSONS = frozenset(
    """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december christmas easter
    montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag januar februar märz mai juni juli oktober dezember weihnachten ostern english german french spanish italian dutch danish swedish polish russian portuguese japanese european
    american british chinese england germany france spain italy netherlands holland denmark sweden norway poland russia portugal japan china america europe africa asia london berlin paris madrid rome milan lisbon amsterdam rotterdam copenhagen
    stockholm warsaw moscow tokyo vienna wien zürich münchen hamburg köln frankfurt deutschland österreich schweiz frankreich spanien italien france espagne allemagne lyon marseille barcelona sevilla valencia españa francia alemania roma milano torino napoli
    italia germania lisboa porto brasil brazil utrecht nederland københavn danmark göteborg sverige warszawa kraków gdańsk polska москва россия петербург brussels dublin chicago york boston oxford cambridge internet ok tv pc uno eu usa uk""".split()
)
# What may stand between the capitalised words of a name.
PARTICLES = frozenset("de da do dos das del della di van von der den ten ter zu af bin ibn al el la le".split())
_CLASSES = {
    # Words before and behind a name, by what they tell.
    "title": "doktor mr mr. mrs mrs. ms ms. miss dr dr. prof prof. doctor professor sir herr herrn frau señor señora sr sr. sra sra. don doña monsieur madame mme m. signor signora dottor dottoressa senhor senhora dona meneer mevrouw dhr mevr fru hr pan pani panu господин госпожа",
    "kin": "neighbour neighbor colleague boss uncle aunt cousin brother sister friend wife husband son daughter mother father nurse teacher nachbar nachbarin kollege kollegin kollegen chef chefin onkel tante bruder schwester freund freundin vecino vecina hermano hermana amigo amiga tío tía voisin voisine collègue frère sœur ami amie oncle tante zio zia amico amica collega fratello sorella vizinho vizinha amigo tio tia irmão irmã collega buurman buurvrouw broer zus vriend vriendin kollega granne bror syster vän nabo bror søster ven sąsiad sąsiadka kolega koleżanka brat siostra сосед соседка брат сестра коллега друг подруга тётя дядя colleagues neighbours neighbors nachbarn compañeros compañeras collègues colleghi colegas vizinhos collega's buren kolleger kollegor kollegerne kollegorna naboerne grannarna koledzy sąsiedzi коллеги соседи",
    "article": "a an the this that these those my your our their his her its der die das den dem des ein eine einen einem einer eines mein meine meinen meinem meiner unser unsere unserem unserer ihr ihre ihrem ihren sein seine seinem jeder jede jedes kein keine keinen keinem el la los las un una unos unas mi su mis sus le les une des du mon ma mes notre il lo gli i uno una nel nella al alla del della os as um uma no na meu minha het een de deze dit mijn onze den det en ett ten ta to te каждый эта этот to im am zum zur beim vom ins ans varje hver hvert denna denne dessa disse vår våra vores min din sin każda ten nasz nasza наш наша chaque cada ogni elke iedere",
    "place": "in at near from to into outside around towards through across aus nach bei auf en desde hasta à dans vers chez in a da verso em para naar uit i till från fra til w do z we в из на к under",
    "person": "with by for about than like wie als como comme come zoals dan än end jak niż как чем neither nor either weder noch ni né varken hverken ani ни mit von für gegen ohne wie con por para según avec par pour sans con per tra com por sem met door voor över med av för af om z od dla przez о с для от u",
    "and": "and or und oder y e o et ou en of och eller og lub i и или but aber pero mais ma mas maar men ale но",
    "speech": "tell told ask asked thank thanks met meet called call see saw saying said says invite invited hello hi hey dear sagte sagt fragte fragt meinte rief hallo liebe lieber danke dijo dice preguntó hola gracias querido querida dit demandé bonjour merci cher chère disse dice chiesto ciao grazie caro cara disse olá obrigado obrigada querido vroeg zei hallo bedankt sa frågade hej tack sagde spurgte tak powiedział powiedziała zapytał cześć сказал сказала спросил привет seen see know find gesehen getroffen kennst kenne visto veo encuentro vu vois trouvé vedo conosci trovo viu vejo conheces gezien zie ken sett träffat känner set mødt kender widziałeś widziałaś widzę znasz видел видела знаешь name namens heiße heißt llamo llama m'appelle chiamo chiama chamo heet heter hedder nazywam зовут",
    "that": "that if when while because whether dass wenn ob weil als que si cuando porque quand parce che se quando perché quando dat als omdat wanneer att om när eftersom at hvis når że gdy kiedy bo что если когда ask where who",
    "be": "is was has had will would can could should does did are were ist war hat hatte wird wurde kann muss soll will es fue era ha había puede está estaba est a avait était va peut sera è era ha aveva può sarà stava foi é tem tinha vai pode heeft zal kan wil moet är var har hade ska kan vill er havde skal jest był była ma będzie może был была будет может",
    "person_next": "who whose der die den que qui che que die som który która который которая myself herself himself",
    "thing": "station bridge catalogue catalog street road depot harbour airport hospital school church hotel museum valley river lake island county university company ltd inc gmbh ag brand model magazine newspaper line avenue square bahnhof brücke platz puente estación café centre center theatre park building project system group team office shop bank foundation institute festival cup award report version machine engine",
}
_CLASS_OF: dict[str, set[str]] = {}
for _name, _words in _CLASSES.items():
    for _w in _words.split():
        _CLASS_OF.setdefault(_w, set()).add(_name)
_NOUN_ENDINGS = re.compile(r"(?:ungen|ung|heit|keit|schaft|tion|tät|nis|tum|ling|chen|lein|plan|raum|haus|stelle|zeit|tag|morgen|abend|nacht|woche|jahr|liste|zahl|stück|werk|zeug|wagen|buch|platz)$")
_PLACE_ENDINGS = re.compile(r"(?:burg|ville|shire|stadt|heim|hausen|dorf|land|ia|bury|mouth|borough|chester|grad)$")
_VERB_ENDINGS = re.compile(r"(?:[^aeiou]ed|[a-z]{2}s|te|ten|tet|ierte|ó|ió|aba|ía|ait|era|ava|iva|ato|ito|ou|eu|iu|de|ade|ede|ał|ała|ил|ила|ал|ала|ла)$")

_GERMAN = re.compile(r"\b(?:der|die|das|und|ist|ein|eine|einen|nicht|ich|wir|sie|mit|auf|für|hat|den|dem|zum|im|am|du|wird|wurde|geht|bei|nach)\b", re.I)

TOKEN = re.compile(r"[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*")
_NEXT = re.compile(r"(,?) ?([^\W\d_]+(?:['’][^\W\d_]+)*|\d+)?")
_STOP = re.compile(r"[.!?…:;\"“”„«»()\[\]{}*♪/|>#\n-]")


#: Lower-case tokens of a later rank are as rare as names, or pieces of words.
LATE = 40_000


@cache
def _tokens(paths: tuple[str, ...]) -> frozenset[bytes]:
    found = set()
    for path in paths:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        found.update(w[1:] for w, rank in ranks.items() if w[:1] == b" " and (rank < LATE or not w[1:].decode(errors="replace").islower()))
    return frozenset(found)


@cache
def word_class(word: str, paths: tuple[str, ...] = VOCABULARIES) -> str:
    """common (has a token in lower case), proper (with a capital only) or rare."""
    known, low = _tokens(paths), word.lower()
    return "common" if low.encode() in known else "proper" if (low[:1].upper() + low[1:]).encode() in known else "rare"


def _capital(w: str) -> bool:
    return w[:1].isupper() and (len(w) == 1 or not w.isupper())


def _left(text: str, a: int) -> tuple[str, bool]:
    """(word before a, whether it begins a sentence there)."""
    i = a
    while i and text[i - 1] in " \t,'’":
        i -= 1
    if not i or _STOP.match(text[i - 1]) and not (text[i - 1] == "." and _abbreviated(text, i - 1)):
        return ("", True)
    if "," in text[i:a]:
        return (",", False)
    j = i - 1 if text[i - 1] == "." else i
    while j and (text[j - 1].isalnum() or text[j - 1] in "'’"):
        j -= 1
    return (text[j:i].lower(), False)


_ABBREVIATIONS = frozenset("mr mrs ms dr prof sr sra st mme m".split())


def _abbreviated(text: str, dot: int) -> bool:
    j = dot
    while j and text[j - 1].isalpha():
        j -= 1
    word = text[j:dot]
    return word.lower() in _ABBREVIATIONS or len(word) == 1 and word.isupper()


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of capitalised words next to each other, particles between them included, as word spans."""
    out: list[list[tuple[int, int]]] = []
    run: list[tuple[int, int]] = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        w = m[0]
        near = bool(run) and (text[run[-1][1] : a] in (" ", "\xa0") or text[run[-1][1] : a] == ". " and run[-1][1] - run[-1][0] == 1)
        if _capital(w):
            if not near:
                if run:
                    out.append(run)
                run = []
            run.append((a, b))
        elif near and w in PARTICLES:
            run.append((a, b))
        elif run:
            out.append(run)
            run = []
    if run:
        out.append(run)
    for r in out:
        while r and not text[r[-1][0]].isupper():
            r.pop()
    return [r for r in out if r]


def _german(text: str, a: int) -> bool:
    """Whether the line of a position is in a language that writes all nouns with a capital."""
    end = text.find("\n", a)
    return bool(_GERMAN.search(text, text.rfind("\n", 0, a) + 1, end if end >= 0 else len(text)))


def _features(text: str, run: list[tuple[int, int]], i: int, j: int, nouns: str) -> list[str]:
    """What tells about words i to j of a run. nouns marks the features of words in a line of German."""
    a, b = run[i][0], run[j - 1][1]
    words = [text[x:y] for x, y in run[i:j]]
    caps = [w for w in words if w[0].isupper()]
    lows = [w.lower() for w in caps]
    before, begins = _left(text, a)
    k = b
    tail = text[b : b + 2]
    possessive = tail in ("'s", "’s")
    if possessive:
        k += 2
    m = _NEXT.match(text, k)
    comma, after = bool(m[1]), (m[2] or "").lower()
    f = ["bias", f"{nouns}n={min(len(caps), 4)}&last={word_class(lows[-1])}", f"{nouns}first={word_class(lows[0])}", f"n={min(len(caps), 4)}", f"first={word_class(lows[0])}", f"last={word_class(lows[-1])}"]
    given = lows[0] in GIVEN_NAMES
    f += ["given"] if given else []
    f += [f"given&n={min(len(caps), 3)}"] if given else []
    f += ["no_person"] * any(w in NO_PERSONS for w in lows)
    f += ["noun_end"] * bool(_NOUN_ENDINGS.search(lows[-1])) + ["place_end"] * bool(_PLACE_ENDINGS.search(lows[-1]))
    f += [f"class:{c}" for w in lows for c in _CLASS_OF.get(w, ()) if c in ("title", "kin", "article", "thing", "that", "be", "and")]
    f += ["begins"] * begins + (["begins&common"] if begins and word_class(lows[0]) == "common" and not given else []) + ([f"begins&n={min(len(caps), 3)}&{word_class(lows[0])}"] if begins else [])
    left_in, right_in = i > 0 and not begins, j < len(run)
    f += ["left_in"] * left_in + ["right_in"] * right_in
    left = text[run[i - 1][0] : run[i - 1][1]].lower() if left_in else ""
    f += [f"left_in={word_class(left)}", f"left_in&{word_class(left)}&{word_class(lows[0])}"] if left else []
    f += ["left_given"] * (left in GIVEN_NAMES)
    classes = _CLASS_OF.get(before, {"none"} if before and before != "," else set())
    if left:  # within a run only what kind of word stands there counts
        classes, before = {c for c in _CLASS_OF.get(left, ()) if c in ("title", "kin", "article", "speech", "that", "be", "and")} | {"run"}, ""
    f += [f"{nouns}before:{c}&{word_class(lows[0])}" for c in classes or {"start"}]
    f += [f"before:{c}" for c in classes] + ["before:,"] * (before == ",")
    f += [f"before:{c}&n={min(len(caps), 2)}" for c in classes]
    f += ["after:'s"] * possessive
    if right_in:
        nxt = text[run[j][0] : run[j][1]].lower()
        f += ["after:thing"] * ("thing" in _CLASS_OF.get(nxt, ())) + [f"right_in={word_class(nxt)}"]
    else:
        after_classes = _CLASS_OF.get(after, set())
        f += [f"after:{c}" for c in after_classes] + ["after:end"] * (not after and not comma) + ["after:,"] * comma + ["after:number"] * after.isdigit()
        verb = bool(after and not comma and not after_classes and _VERB_ENDINGS.search(after))
        f += ["after:verb"] * verb + ([f"begins&verb={word_class(lows[0])}"] if verb and begins else [])
        plain = bool(after and not comma and not after_classes and not after.isdigit())
        f += [f"{nouns}after:lower&{word_class(lows[-1])}"] * plain + [f"{nouns}begins&after:lower&n={min(len(caps), 2)}&{word_class(lows[0])}"] * (plain and begins)
        f += [f"begins&be={word_class(lows[0])}"] if begins and "be" in after_classes else []
    f += [f"prev={before}"] * bool(before) + [f"next={after}"] * (bool(after) and not comma and not right_in)
    f += [f"{nouns}tail={lows[-1][-2:]}"] if len(lows[-1]) > 3 else []
    f += [f"begins&tail={lows[-1][-4:]}"] if begins and len(lows[-1]) > 6 else []
    f += [f"only:{'+'.join(sorted(classes))}&{word_class(lows[0])}"]
    f += ["initial"] * any(len(w) == 1 for w in caps) + ["lone_initial"] * (len(caps) == 1 and len(caps[0]) == 1)
    f += ["inner_capital"] * any(len(w) > 2 and not w[1:].islower() and "-" not in w and "'" not in w and "’" not in w for w in caps)
    f += [f"shape={'-'.join(word_class(w)[0] for w in lows[:3])}"]
    return f


MOST_WORDS = 4


def _spans(run: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    n = len(run)
    upper = [text[a].isupper() for a, _ in run]
    return [(i, j) for i in range(n) if upper[i] for j in range(i + 1, min(n, i + MOST_WORDS + 1) + 1) if upper[j - 1]]


def _marked(example: str) -> tuple[str, set[tuple[int, int]]]:
    text, names, at = "", set(), None
    for part in re.split(r"([\[\]])", example):
        if part == "[":
            at = len(text)
        elif part == "]":
            names.add((at, len(text)))
        else:
            text += part
    return text, names


@cache
def fit(strength: float = 0.001, rounds: int = 25) -> dict[str, float]:
    """Weights of the features: logistic regression on all spans of the runs of the examples, by Newton's steps."""
    rows, labels = [], []
    for example in EXAMPLES:
        text, names = _marked(example)
        for run in runs(text):
            for i, j in _spans(run, text):
                rows.append(_features(text, run, i, j, "de&" if _german(text, run[0][0]) else ""))
                labels.append((run[i][0], run[j - 1][1]) in names)
    index: dict[str, int] = {}
    for f in rows:
        for x in f:
            index.setdefault(x, len(index))
    x = np.zeros((len(rows), len(index)))
    for r, f in enumerate(rows):
        for v in f:
            x[r, index[v]] = 1.0
    y, w, loss = np.array(labels, dtype=float), np.zeros(len(index)), strength / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + loss * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(y) + loss * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return {f: float(w[k]) for f, k in index.items()}


_fitted: dict[str, float] = {}


def model() -> dict[str, float]:
    """The weights in use in this process."""
    return _fitted or use(fit())


def use(weights: dict[str, float]) -> dict[str, float]:
    """Take on weights fitted elsewhere: the driver fits, the tasks get them with their code."""
    if not _fitted:
        _fitted.update(weights)
    return _fitted


_NO_NAMES = re.compile(r"(?:speaker|spkr?|sprecher(?:in)?|hablante|locut(?:or|eur)|orador|parlante|spreker|talare?r?|mówca|спикер|[uaehäöøå]+[hmr]+|[he]+u+h*|[mh]+-?[mh]+|u+h+-h?u+h+)$", re.I)


def _no_name(text: str, run: list[tuple[int, int]]) -> bool:
    """Whether a run of one word is a label of speakers, a sound, a compound of common words, or a common word that begins a sentence."""
    if len(run) > 1:
        return False
    word = text[run[0][0] : run[0][1]]
    if word_class(word) == "common" and word.lower() not in GIVEN_NAMES and _left(text, run[0][0])[1]:
        return True
    if word.lower() in _CLASS_OF and word.lower() not in GIVEN_NAMES:
        return True
    parts = re.split(r"['’-]", word)
    return bool(_NO_NAMES.match(word)) or len(parts) > 1 and all(len(p) < 3 or word_class(p) == "common" for p in parts)


def names_in(text: str, least: float = -0.3) -> list[tuple[int, int]]:
    """Spans of persons' names in a text with capitals, none within another; a line break ends a sentence."""
    found, weights = [], model()
    for run in runs(text):
        if _no_name(text, run):
            continue
        nouns = "de&" if _german(text, run[0][0]) else ""
        scored = sorted(((sum(weights.get(f, 0.0) for f in _features(text, run, i, j, nouns)), i, j) for i, j in _spans(run, text)), reverse=True)
        taken: list[tuple[int, int]] = []
        for s, i, j in scored:
            if s <= least:
                break
            if all(j <= c or i >= d for c, d in taken):
                taken.append((i, j))
        found += [(run[i][0], run[j - 1][1]) for i, j in taken]
    return sorted(found)
