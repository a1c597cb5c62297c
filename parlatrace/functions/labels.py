"""One spelling for the speaker that a label names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: The numbers 0 to 99 in words, in order.
NUMBER_WORDS = _UNITS + [t + ("-" + _UNITS[u] if u else "") for t in _TENS for u in range(10)]

#: What a label may be made of once lowered and in plain digits: a word, a separator, a number (an O standing for a zero).
NUMBERED = r"^\p{L}*?[\s_.#-]*(o?[0-9][0-9o]*)$"
WORDED = r"^\p{L}+[\s_-]+([a-z]+(?:-[a-z]+)?)$"
#: The same with what may stand around it: overlap marks, brackets, a colon.
_NUMBERED_WHOLE, _WORDED_WHOLE = (rf"^ *(?:/+\s*\[?|\[)? *{p[1:-1]}[\s:\]/]*$" for p in (NUMBERED, WORDED))
_WIDE, _PLAIN = "０１２３４５６７８９\u00a0\u2007\u202f", "0123456789   "


def speaker_of(label: Column) -> Column:
    """'S03' for 'SPEAKER_03', 'speaker-003', 'Spk 3', '//S3', 'SPEAKER_O3', 'Speaker three' and the like.

    Full-width digits and no-break spaces count as plain ones, leading zeros and overlap marks don't count. A label that tells
    no number (null, empty, 'UNKNOWN', 'noise') gives null.
    """
    flat = F.lower(F.translate(label, _WIDE, _PLAIN))
    # An expression that is read twice is worked out twice, so each step reads the one before once. Lambdas and nullif would keep plans that
    # read the same labels from sharing a shuffle, so what isn't found is null by its place in an array.
    digits = F.regexp_replace(F.translate(F.get(F.regexp_extract_all(flat, F.lit(_NUMBERED_WHOLE), 1), F.lit(0)), "o", "0"), "^0+(?=.)", "")
    numbered = F.regexp_replace(F.concat(F.lit("S0"), digits), "^S0(?=[0-9]{2})", "S")
    word = F.get(F.regexp_extract_all(flat, F.lit(_WORDED_WHOLE), 1), F.lit(0))
    place = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), word).cast("int")
    return F.coalesce(numbered, F.get(F.array(*[F.lit(f"S{n:02d}") for n in range(len(NUMBER_WORDS))]), place - 1))


def with_speaker(df: DataFrame, label: str = "label", name: str = "speaker") -> DataFrame:
    """df without its label but with the speaker it names, worked out once a row: a generated column, which no filter on it is pushed through."""
    return df.select(*[c for c in df.columns if c != label], F.explode(F.array(speaker_of(F.col(label)))).alias(name))


def speaker_of_sql(label: str) -> str:
    """The same for DuckDB."""
    words = "[" + ", ".join(f"'{w}'" for w in NUMBER_WORDS) + "]"
    flat = f"trim(lower(translate({label}, '{_WIDE}', '{_PLAIN}')))"
    core = f"trim(regexp_replace({flat}, '^/+\\s*\\[?|^\\[|[\\s:\\]/]+$', '', 'g'))"
    digits = f"ltrim(replace(regexp_extract({core}, '{NUMBERED}', 1), 'o', '0'), '0')"
    has = f"regexp_matches({core}, '{NUMBERED}')"
    word = f"list_position({words}, regexp_extract({core}, '{WORDED}', 1)) - 1"
    return (
        f"case when {has} then 'S' || case when length({digits}) < 2 then lpad({digits}, 2, '0') else {digits} end "
        f"when {word} >= 0 then 'S' || lpad(cast({word} as varchar), 2, '0') end"
    )


def short_label(label: Column) -> Column:
    """'S01' for 'SPEAKER_01', by position: whatever follows the eighth character."""
    return F.concat(F.lit("S"), F.substring(label, 9, 1_000_000))


_NUMBERED = re.compile(r"^[^\W\d_]*?[\s_.#-]*(o?[0-9][0-9o]*)$")
_WORDED = re.compile(r"^[^\W\d_]+[\s_-]+([a-z]+(?:-[a-z]+)?)$")


def speaker_name(label: str | None) -> str | None:
    """speaker_of for a single string."""
    core = re.sub(r"^/+\s*\[?|^\[|[\s:\]/]+$", "", (label or "").translate(str.maketrans(_WIDE, _PLAIN)).strip().lower()).strip()
    if m := _NUMBERED.match(core):
        return "S" + (m[1].replace("o", "0").lstrip("0") or "0").rjust(2, "0")
    if (m := _WORDED.match(core)) and m[1] in NUMBER_WORDS:
        return f"S{NUMBER_WORDS.index(m[1]):02d}"
    return None
