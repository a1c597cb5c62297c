"""Personal data in transcripts: mentions, placeholders, and surrogates that keep what the text needs to stay readable."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache
from secrets import token_hex

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlatrace.llm import name_model
from parlatrace.llm.pii_rules import SMALL_NUMBERS, Mention, mentions
from parlatrace.session import cut

ROUNDS = 3
LAST_ATTEMPT = 9
_DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
}
_ALSO = {"oh": ("en", 0), "o": ("en", 0), "zwo": ("de", 2)}
_VALUE_OF = {w: (lang, n) for lang, words in _DIGIT_WORDS.items() for n, w in enumerate(words)} | _ALSO
# Syllables that surrogate names are made of, by script, and endings by gender.
_SYLLABLES = {"LATIN": "ba be bi bo da de do fa fe fi ga ge go ka ke ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se so ta te ti to va ve vi wa we za ze zo".split(), "CYRILLIC": "ба бе бо ва ве да де до за зе ка ке ко ла ле ли ма ме ми на не но па пе ра ре ро са се со та те".split(), "HIRAGANA": "あ い う か き く さ し す た ち つ な に の は ひ ま み も や ゆ ら り る わ".split()}
_ENDINGS = {("LATIN", "f"): ("na", "la", "ra", "sia"), ("LATIN", "m"): ("n", "r", "k", "s"), ("CYRILLIC", "f"): ("на", "ла", "ра"), ("CYRILLIC", "m"): ("н", "р", "к"), ("HIRAGANA", "f"): ("こ", "み"), ("HIRAGANA", "m"): ("た", "と")}
_SMALL = SMALL_NUMBERS.split("|")
_FEMALE = re.compile(r"(?:frau|mrs|ms|miss|señora|señorita|sra|doña|madame|mme|signora|fru|aunt|sister|mother|wife|daughter|tante|schwester)\.?\s*$", re.I)
_MALE = re.compile(r"(?:herrn?|mr|sir|señor|sr|don|monsieur|signor|uncle|brother|father|husband|son|onkel|bruder)\.?\s*$", re.I)
_STREET_KINDS = frozenset("street str st road rd avenue ave lane ln close crescent terrace gardens garden row yard hill quay drive court place square way park mews walk grove boulevard flat apartment apt unit suite calle avenida plaza paseo camino número numero de del la los las am an der im auf dem zum zur weg gasse allee platz rue via via".split())


# ---- surrogates of single values


def _stream(key: str, *parts: object):
    """Numbers that depend on the key and the parts only."""
    seed, n = "\x1f".join(map(str, parts)), 0
    while True:
        block = hashlib.blake2b(f"{n}\x1f{seed}".encode(), key=key.encode()[:64], digest_size=64).digest()
        yield from (int.from_bytes(block[i : i + 4], "big") for i in range(0, 64, 4))
        n += 1


def _script(word: str) -> str:
    for c in word:
        if c.isalpha():
            name = unicodedata.name(c, "LATIN").split()[0]
            return "HIRAGANA" if name in ("HIRAGANA", "KATAKANA", "CJK") else name if name in _SYLLABLES else "LATIN"
    return "LATIN"


def _cased(model: str, word: str) -> str:
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word


def gender_of(word: str, before: str = "") -> str:
    """f or m, by the title before a name, else by its ending: a surrogate ends alike."""
    return "f" if _FEMALE.search(before) else "m" if _MALE.search(before) else "f" if word[-1:].lower() in "aeаея" else "m"


_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん")


def _alphabet(letter: str) -> str:
    """The letters an initial is swapped among: those of its alphabet, else the like ones of its script near it in Unicode."""
    for known in _ALPHABETS:
        if letter in known:
            return known
    cased = lambda c: len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c
    like = lambda c: c.isalpha() and c.lower() == c and cased(c) == cased(letter) and _script(c) == _script(letter) and not any(c in known for known in _ALPHABETS)
    block = ord(letter) // 128 * 128
    return "".join(c for c in map(chr, range(block, block + 128)) if c == letter or like(c))


@lru_cache(maxsize=4096)
def _initial(letter: str, key: str) -> str:
    """Another letter of the alphabet, by a keyed permutation that leaves none where it is: different initials stay different."""
    order = sorted(_alphabet(letter), key=lambda c: (next(_stream(key, "initial", c)), c))
    return order[(order.index(letter) + 1) % len(order)]


def name_word(word: str, key: str, attempt: int, gender: str) -> str:
    """A made-up word in place of one of a name: same script and case, an ending of the same gender; an initial stays an initial. Every further attempt makes a longer word, so there is always room."""
    bare = word.strip(".")
    if len(bare) == 1:
        return _cased(bare, _initial(bare.lower() if len(bare.lower()) == 1 else bare, key)) + word[1:]
    numbers = _stream(key, "name", bare.lower(), attempt)
    script = _script(bare)
    syllables = _SYLLABLES[script]
    made = "".join(syllables[next(numbers) % len(syllables)] for _ in range(3 + attempt))
    endings = _ENDINGS[script, gender]
    return _cased(bare, made + endings[next(numbers) % len(endings)])


_CALLING_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


def _kept(kind: str, identity: str) -> int:
    """How many characters of a number a surrogate keeps: those that tell the country, or the kind of area."""
    if kind != "phone":
        return 0
    if identity[:1] == "+" or identity[:2] == "00" or identity[:1] != "0" and len(identity) > 10:
        skip = 1 if identity[0] == "+" else 2 if identity[0] == "0" else 0
        code = _CALLING_CODE.match(identity, skip)
        return code.end() if code else skip
    return 2 if identity[:1] == "0" else 1


def _drawn(kind: str, identity: str, key: str, attempt: int) -> str:
    """The characters of a number's surrogate without separators: digits for digits and letters for letters, drawn from what all its spellings share."""
    numbers, keep, out = _stream(key, kind, identity, attempt), _kept(kind, identity), []
    for i, c in enumerate(identity):
        n = next(numbers)
        out.append(c if i < keep else str(n % 10) if c.isdigit() else chr(ord("a") + n % 26))
    return "".join(out).removeprefix("+")


def _bare(value: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c.lower()[0] for c in value.replace("(0)", "") if c.isalnum())


def _laid(value: str, drawn: str) -> str:
    """The drawn characters in the format of value: its separators, and a zero in brackets, as they are."""
    left = iter(drawn)
    return "".join(c if not c.isalnum() or value[max(0, i - 1) : i + 2] == "(0)" else _cased(c, next(left)) for i, c in enumerate(value))


# How the joints of a mail address are spoken.
_MAIL_JOINTS = frozenset("dot punkt punto underscore unterstrich guion bajo dash hyphen minus plus bindestrich".split())
# Short forms of words of addresses.
_ADDRESS_SHORT = {"st": "street", "str": "straße", "strasse": "straße", "rd": "road", "ave": "avenue", "avda": "avenida", "ln": "lane", "ct": "court", "dr": "drive", "blvd": "boulevard", "apt": "apartment", "núm": "número", "numero": "número"}


def surrogate(kind: str, value: str, key: str, attempt: int = 0, gender: str = "m") -> str:
    """A value of the same type and format in place of another. The same value, key and attempt give the same surrogate."""
    identity = identity_of(kind, value)
    if kind == "name":
        return name_word(value, key, attempt, gender)
    if kind in ("phone", "id_number"):
        words = re.findall(r"[^\W\d_]+", value.lower())
        if not any(c.isdigit() for c in value) and any(w in _VALUE_OF for w in words):
            digits = iter(_drawn(kind, identity, key, attempt))
            spell = lambda m: _DIGIT_WORDS[_VALUE_OF[m[0].lower()][0]][int(next(digits, "0"))] if m[0].lower() in _VALUE_OF else m[0]
            plain = re.sub(r"\b(double|doble|triple)[ ,-]+([^\W\d_]+)", lambda m: " ".join([m[2]] * (3 if m[1].lower() == "triple" else 2)) if m[2].lower() in _VALUE_OF else m[0], value, flags=re.I)
            return re.sub(r"[^\W\d_]+", spell, plain)
        return _laid(value, _drawn(kind, identity, key, attempt))
    if kind == "email":
        at = re.search(r"\s*\(at\)\s*|\s*\[at\]\s*|\s+at\s+|\s+arroba\s+|\s+ät\s+|\s?@\s?", value, re.I)
        local, host = value[: at.start()] if at else value, value[at.end() :] if at else ""
        numbers = _stream(key, "email", identity, attempt)
        first = 2 + attempt

        def part(m: re.Match) -> str:
            nonlocal first
            if m[0].lower() in _MAIL_JOINTS:
                return m[0]
            if m[0].isdigit():
                return "".join(str(next(numbers) % 10) for _ in m[0])
            made = "".join(_SYLLABLES["LATIN"][next(numbers) % len(_SYLLABLES["LATIN"])] for _ in range(first))
            first = 2
            return _cased(m[0], made)

        spoken = re.sub(r"[^\W\d_]+|\d+", part, local)
        name = "".join(_SYLLABLES["LATIN"][next(numbers) % len(_SYLLABLES["LATIN"])] for _ in range(3))
        dot = re.search(r"\s*\(dot\)\s*|\s*\[dot\]\s*|\s+dot\s+|\s+punkt\s+|\s+punto\s+|\.", host, re.I)
        return spoken + (at[0] if at else "@") + _cased(value, name) + (dot[0] if dot else ".") + _cased(value, "example")
    numbers = _stream(key, "address", identity, attempt)

    def swap(m: re.Match) -> str:
        w = m[0]
        if w.isdigit():
            return str(next(numbers) % 9 + 1) + "".join(str(next(numbers) % 10) for _ in w[1:])
        if w.lower() in _SMALL:
            return _cased(w, _SMALL[next(numbers) % len(_SMALL)])
        if w.lower() in _STREET_KINDS or len(w) == 1:
            return w
        tail = re.search(r"(?:straße|strasse|gasse|allee|weg|platz|straat|laan|gatan|vägen)$", w, re.I)
        made = "".join(_SYLLABLES[_script(w)][next(numbers) % len(_SYLLABLES[_script(w)])] for _ in range(3 + attempt))
        return _cased(w, made) + (tail[0].lower() if tail else "")

    return re.sub(r"\d+|[^\W\d_]+", swap, value)


def identity_of(kind: str, value: str) -> str:
    """What two mentions of one thing share, however they are written."""
    low = value.lower()
    if kind in ("phone", "id_number"):
        words = re.findall(r"[^\W\d_]+", low)
        if not any(c.isdigit() for c in value) and any(w in _VALUE_OF for w in words):
            out, times = [], 1
            for w in words:
                if w in _VALUE_OF:
                    out.append(str(_VALUE_OF[w][1]) * times)
                    times = 1
                else:
                    times = {"double": 2, "doble": 2, "triple": 3}.get(w, 1)
            return "".join(out)
        bare = _bare(value)
        return "+" + bare if kind == "phone" and value[:1] == "+" and len(bare) <= 10 else bare
    if kind == "email":
        low = re.sub(r"\s*[(\[]at[)\]]\s*|\s+at\s+|\s+arroba\s+|\s+ät\s+", "@", low)
        low = re.sub(r"\s*[(\[]dot[)\]]\s*|\s+dot\s+|\s+punkt\s+|\s+punto\s+", ".", low)
        low = re.sub(r"\s+(?:underscore|unterstrich|guion bajo)\s+", "_", low)
        return re.sub(r"\s+", "", re.sub(r"\s+(?:dash|hyphen|minus|bindestrich)\s+", "-", low))
    if kind == "address":
        return re.sub(r"[^\W\d_]+", lambda m: _ADDRESS_SHORT.get(m[0], m[0].replace("strasse", "straße")), re.sub(r"[\s.,]+", " ", low).strip())
    return re.sub(r"[\s.,]+", " ", low).strip()


MENTIONS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("value", T.StringType())]
        + [T.StructField("words", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("identity", T.StringType()), T.StructField("gender", T.StringType())])))]
    )
)


def _as_row(source: str, m: Mention) -> dict:
    if m.kind == "name":
        before = source[max(0, m.start - 20) : m.start]
        parts = [(x.start(), x[0]) for x in re.finditer(r"[^\W\d_]+\.?", m.value)]
        gender = gender_of(parts[0][1].strip(".") if parts else "", before)
        words = [{"at": a, "word": w, "identity": w.strip(".").lower(), "gender": gender if i == 0 else gender_of(w.strip("."))} for i, (a, w) in enumerate(parts)]
    else:
        words = [{"at": 0, "word": m.value, "identity": identity_of(m.kind, m.value), "gender": None}]
    return {"kind": m.kind, "start_pos": m.start, "end_pos": m.end, "value": m.value, "words": words}


def personal_data(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, kind, start_pos, end_pos, value, words): one row per mention, with its place in the stored string; end_pos is exclusive.

    A text's mentions depend on that text alone. Null and empty texts have none. Rows with one key are taken once. Other columns are ignored.
    """

    weights = name_model.model()

    @F.pandas_udf(MENTIONS)
    def find(texts: pd.Series) -> pd.Series:
        name_model.use(weights)
        return pd.Series([[_as_row(t, m) for m in mentions(t)] if t else [] for t in texts])

    rows = df.where(F.col(key).isNotNull() & F.col(source).isNotNull()).select(key, F.explode(find(source)).alias("m"))
    return rows.select(key, "m.*").dropDuplicates([key, "start_pos"])


def with_surrogates(found: DataFrame, key: str, secret: str, rounds: int = ROUNDS) -> DataFrame:
    """The mentions with their surrogate: keyed, of the same type, gender, script and format.

    Words of names get surrogates of their own, so that a full name and its parts stay recognisable as one person (coreference); other
    kinds get one per thing, however it is written. Different things keep different surrogates, and none gets a value that
    occurs in the data: surrogates are held against each other and against all values, and those that collide are drawn anew,
    `rounds` times, names, mail and street names longer each time. What still collides gets, of a name, mail or address, a word of twelve syllables (one of more
    than 10^20, no longer checked); a number, whose format leaves no room to grow, gets a numbered placeholder. Initials are permuted within their alphabet, so
    they need no such check, but another's initial may be among them. A name taken for a woman's once is one
    throughout. Only these exceptions are joined back.
    """

    @F.pandas_udf(T.StringType())
    def draw(kind: pd.Series, word: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, w, secret, int(a), g or "m") for k, w, g, a in zip(kind, word, gender, attempt, strict=True)])

    @F.pandas_udf(T.StringType())
    def identity(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([v.strip(".").lower() if k == "name" else identity_of(k, v) for k, v in zip(kind, value, strict=True)])

    found = cut(found, "mentions")  # finding them is the dear part, and both branches below read them
    parts = found.select(key, "kind", "start_pos", "end_pos", "value", F.explode("words").alias("w")).select(key, "kind", "start_pos", "end_pos", "value", "w.*")
    things = parts.where(F.length("identity") > 1).groupBy("kind", "identity").agg(F.min("word").alias("word"), F.min("gender").alias("gender"), (F.min("gender") < F.max("gender")).alias("doubtful"))
    real = things.select("kind", F.col("identity").alias("made"), F.lit(True).alias("occurs"))
    state = things.withColumn("attempt", F.lit(0))
    group = Window.partitionBy("kind", "made").orderBy("attempt", "identity")
    for _ in range(rounds):
        drawn = state.withColumn("made", identity("kind", draw("kind", "word", "gender", "attempt")))
        drawn = drawn.withColumn("rank", F.row_number().over(group)).join(real, ["kind", "made"], "left")
        again = (F.col("rank") > 1) | F.col("occurs").isNotNull()
        state = drawn.select("kind", "identity", "word", "gender", "doubtful", (F.col("attempt") + F.when(again, 1).otherwise(0)).alias("attempt"))
    last = state.withColumn("made", identity("kind", draw("kind", "word", "gender", "attempt"))).withColumn("rank", F.row_number().over(group)).join(real, ["kind", "made"], "left")
    clash = (F.col("rank") > 1) | F.col("occurs").isNotNull()
    number = F.col("kind").isin("phone", "id_number")
    exceptions = last.where((F.col("attempt") > 0) | clash | F.col("doubtful")).select(
        "kind", "identity", F.when(clash & ~number, LAST_ATTEMPT).otherwise(F.col("attempt")).alias("attempt"), F.col("gender").alias("agreed"), F.when(clash & number, F.concat(F.lit("["), F.upper("kind"), F.lit(" "), F.substring(F.sha2(F.concat_ws("|", "kind", "identity", F.lit(secret)), 256), 1, 12), F.lit("]"))).alias("numbered")
    )
    parts = parts.join(exceptions, ["kind", "identity"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    parts = parts.withColumn("s", F.coalesce("numbered", draw("kind", "word", F.coalesce("agreed", "gender"), "attempt")))
    whole = parts.groupBy(key, "start_pos").agg(
        F.first("kind").alias("kind"), F.first("end_pos").alias("end_pos"), F.first("value").alias("value"), F.array_sort(F.collect_list(F.struct("at", F.length("word").alias("n"), "s"))).alias("p")
    )
    # what stands between the words stays
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(F.concat(a["t"], F.substring(F.col("value"), a["end"] + 1, x["at"] - a["end"]), x["s"]).alias("t"), (x["at"] + x["n"]).alias("end"))
    text = F.aggregate("p", zero, step, lambda a: F.concat(a["t"], F.substring(F.col("value"), a["end"] + 1, F.length("value"))))
    return whole.select(key, "kind", "start_pos", "end_pos", "value", text.alias("surrogate"))


_TAGS = re.compile(r"<[^>]+>")


def replaced(source: str, spans: list[tuple[int, int, str]]) -> str:
    """source with the spans (start, end, replacement) replaced; tags within a span stay, behind its replacement."""
    out, end = [], 0
    for a, b, new in sorted(spans):
        out += [source[end:a], new, *_TAGS.findall(source[a:b])]
        end = b
    return "".join(out) + source[end:]


def redacted(df: DataFrame, key: str, source: str, placeholders: dict[str, str]) -> DataFrame:
    """(key, source): the texts with the placeholder of its kind in place of every mention, the rest unchanged; null stays null."""

    weights = name_model.model()

    @F.pandas_udf(T.StringType())
    def redact(texts: pd.Series) -> pd.Series:
        name_model.use(weights)
        one = lambda t: replaced(t, [(m.start, m.end, placeholders.get(m.kind, f"[{m.kind.upper()}]")) for m in mentions(t)])
        return texts.map(one, na_action="ignore")

    return df.select(key, redact(F.col(source)).alias(source))


def pseudonymised(df: DataFrame, key: str, source: str, secret: str) -> DataFrame:
    """(key, source): the texts with surrogates in place of the mentions, the rest unchanged. Keys are unique; null stays null."""
    made = with_surrogates(personal_data(df, key, source), key, secret).groupBy(key).agg(F.collect_list(F.struct("start_pos", "end_pos", "surrogate")).alias("_m"))

    @F.pandas_udf(T.StringType())
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else replaced(t, [(x["start_pos"], x["end_pos"], x["surrogate"]) for x in s]) for t, s in zip(texts, spans, strict=True)])

    rows = df.select(key, source).join(made, key, "left")
    return rows.select(key, put(F.col(source), F.col("_m")).alias(source))


KEY_SETTING = "spark.parlatrace.surrogateKey"


def key_of(spark: SparkSession) -> str:
    """The secret key of surrogates: the session's setting, or, where that is unset, a random one that lasts as long as the session."""
    if not (key := spark.conf.get(KEY_SETTING, None)):
        spark.conf.set(KEY_SETTING, key := token_hex(32))
    return key


def placeholders_of(pii_kinds: DataFrame, most: int = 1000) -> dict[str, str]:
    """kind to placeholder; the table holds settings, more than `most` rows end the query."""
    rows = pii_kinds.where("kind is not null and placeholder is not null").limit(most + 1).collect()
    assert len(rows) <= most, "too many kinds"
    return {r["kind"]: r["placeholder"] for r in rows}
