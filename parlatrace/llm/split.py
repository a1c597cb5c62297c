"""Cutting texts that are too long into pieces, at natural boundaries, by recursive bisection."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlatrace.functions.html import _TAG as TAG
from parlatrace.functions.html import plain_text

MARKS = ".!?。！？…"
PAUSE_MS = 1000
ACCENTS = 4
#: Stand for the ends of blocks and for silence between anchors while a text is read; texts that have them go without such boundaries.
_BLOCK, _SILENCE = "\ue000", "\ue001"
#: Kinds of boundary, the strongest first, each with what it looks like; a cut goes behind the match. Silence told by the times of anchors
#: counts as a pause; between pauses and sentences come the ends of blocks (turns, cues, paragraphs), which the flat text doesn't show.
BOUNDARIES = (
    ("pause", re.compile(r"(?:\(\.+\)|\[[^\[\]]{0,40}\b(?:pause|Pause|pausa)\b[^\[\]]{0,40}\]|\((?:pause|Pause)[^()]{0,40}\))\s*")),
    ("block", None),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”]?\s*")),
    ("clause", re.compile(r"[,;:–—]\s+|[、，；：]\s*")),
    ("space", re.compile(r"\s+")),
    ("mark", re.compile(f"[{MARKS}]+")),
)
KINDS = (*(name for name, _ in BOUNDARIES), "forced")
#: The blocks of Unicode whose characters are mostly combining ones; whether one is, is asked of the character.
_COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u0e4e\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u302a-\u302f\u3099\u309a\ua66f-\uaaf6\ufe20-\ufe2f\U00010000-\U0010ffff]")
_BREAK = re.compile(rf"[\s{MARKS}]")
_ANCHOR = re.compile(r'<a\s[^>]*?name="ts_(\d+)_(\d+)[^>]*>')
_BLOCKS = re.compile(r"</?(?:p|div|li|ul|ol|tr|table|h[1-6]|br|pre)\b[^>]*>", re.I)
_EMPTY_LINES = re.compile(r"\n\s*\n")
_SIGNS = re.compile(rf"\s*[{_BLOCK}{_SILENCE}][\s{_BLOCK}{_SILENCE}]*")


def marked_text(source: str, text: str | None = None) -> tuple[str, dict[str, list[int]]]:
    """(text, places): the flat text of an HTML document and where in it blocks end and the anchors' times tell of silence. text: that text, where it is known."""
    text = (plain_text(source) or "") if text is None else text
    if _BLOCK in source or _SILENCE in source:
        return text, {}
    heard: int | None = None

    def mark(m: re.Match) -> str:
        nonlocal heard
        silent, heard = heard is not None and int(m[1]) - heard >= PAUSE_MS, int(m[2])
        return _SILENCE if silent else ""

    marked = _ANCHOR.sub(mark, source) if 'name="ts_' in source else source
    marked = html.unescape(TAG.sub("", _BLOCKS.sub(_BLOCK, _EMPTY_LINES.sub(f"{_BLOCK} ", marked))))
    out: list[str] = []
    places: dict[str, list[int]] = {"block": [], "pause": []}
    n = end = 0
    for m in _SIGNS.finditer(marked):
        part = " ".join(marked[end : m.start()].split())
        out.append(part)
        n += len(part)
        end = m.end()
        if n and m[0].strip(_BLOCK + _SILENCE):
            out.append(" ")
            n += 1
        for sign, name in ((_BLOCK, "block"), (_SILENCE, "pause")):
            if sign in m[0]:
                places[name].append(n)
    out.append(" ".join(marked[end:].split()))
    same = "".join(out).rstrip() == text
    return text, {k: [p for p in v if 0 < p < len(text)] for k, v in places.items()} if same else {}


def parted_run(text: str, cut: int) -> int:
    """Length of the run without white space and sentence marks that a cut parts; 0 where it parts none."""
    if _BREAK.match(text[cut - 1]) or _BREAK.match(text[cut]):
        return 0
    a = cut - 1
    while a and not _BREAK.match(text[a - 1]):
        a -= 1
    after = _BREAK.search(text, cut)
    return (after.start() if after else len(text)) - a


def bisect(text: str, limit: int, overlap: int, places: dict[str, list[int]] | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, kind of the cut before it, length of the unbroken run that cut parts) of the pieces of a text.

    A text within the limit is one piece. Otherwise it is cut, in the middle half, at the boundary nearest to the middle of the
    strongest kind found there, or at the middle itself, and so are the halves until they are within the limit less the
    overlap. Every piece but the first then begins the overlap earlier, or a few characters more where that would part a letter from its accents; nor do cuts
    part them (room for that is kept in texts with such accents). places: boundaries by kind besides those that show in the text.
    """
    assert 0 <= overlap < limit
    if len(text) <= limit:
        return [(0, len(text), "start", 0)]
    at: dict[str, list[int]] = {}

    def places_of(name: str, pattern: re.Pattern | None) -> list[int]:
        """All boundaries of a kind, looked for once and only where no stronger one is found."""
        if name not in at:
            found = [m.end() for m in pattern.finditer(text)] if pattern else []
            more = (places or {}).get(name)
            at[name] = sorted({*found, *more}) if more else found
        return at[name]

    slack = min(ACCENTS, (limit - overlap) // 4) if not text.isascii() and _COMBINING.search(text) else 0
    room = limit - overlap - slack
    done: list[tuple[int, str]] = []
    todo = [(0, len(text), "start")]
    while todo:
        a, b, kind = todo.pop()
        n = b - a
        if n <= room:
            done.append((a, kind))
            continue
        low, middle, high = a + max(1, n // 4), a + n // 2, b - max(1, n // 4)
        cut, cut_kind = middle, "forced"
        for name, pattern in BOUNDARIES:
            found = places_of(name, pattern)
            i, j, k = bisect_left(found, low), bisect_right(found, high), bisect_left(found, middle)
            near = [found[x] for x in (k - 1, k) if i <= x < j]
            if near:
                cut, cut_kind = min(near, key=lambda p: (abs(p - middle), p)), name
                break
        else:
            while cut > low and unicodedata.combining(text[cut]):
                cut -= 1
        todo += [(cut, b, cut_kind), (a, cut, kind)]
    ends = [a for a, _ in done[1:]] + [len(text)]
    out = []
    for i, ((a, kind), end) in enumerate(zip(done, ends, strict=True)):
        start = exact = max(0, a - overlap) if i else a
        while i and start and exact - start < slack and unicodedata.combining(text[start]):
            start -= 1
        out.append((start, end, kind, parted_run(text, a) if i else 0))
    return out


@dataclass(frozen=True)
class Limit:
    limit_id: int
    capacity: int
    overlap: int


def limits_of(size_limits: DataFrame, most: int = 1000) -> list[Limit]:
    """The piece limits in characters. The table holds settings, not data; more than `most` rows end the query."""
    rows = size_limits.where("purpose = 'piece' and unit = 'chars' and capacity > 0").orderBy("limit_id").limit(most + 1).collect()
    assert len(rows) <= most, "too many limits"
    return [Limit(r["limit_id"], r["capacity"], r["overlap"] or 0) for r in rows]


PIECES = T.ArrayType(
    T.StructType(
        [T.StructField("limit_id", T.IntegerType()), T.StructField("piece_no", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]
        + [T.StructField("cut", T.StringType()), T.StructField("parted", T.IntegerType()), T.StructField("text", T.StringType())]
    )
)


def split_texts(df: DataFrame, keys: list[str], source: Column, limits: list[Limit], is_html: bool = True) -> DataFrame:
    """(keys.., n_chars, limit_id, piece_no, start_pos, end_pos, cut, parted, text): the pieces of each text for each limit.

    source is HTML, whose text is taken first (tags dropped, references decoded, white space collapsed), or plain text. Pieces
    are numbered from 0 in order; positions count characters of the text; end_pos is exclusive; cut is the kind of boundary before the piece, parted the length of
    the run without white space and sentence marks that this cut parts (0 at a natural boundary): a run longer than the limit is always parted. Other columns are
    ignored, so their names can't clash. A null or empty text gives no piece. Repeated rows give their pieces again.
    """
    inner = T.StructType([T.StructField("n_chars", T.IntegerType()), T.StructField("pieces", PIECES)])
    least = min((x.capacity for x in limits), default=0)
    fixed = [(x.limit_id, x.capacity, x.overlap) for x in limits]

    @F.pandas_udf(inner)
    def cut_up(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in texts:
            text, places = (plain_text(raw) if is_html else raw) or "", None
            if is_html and len(text) > least:
                text, places = marked_text(raw, text)
            pieces = []
            for limit_id, capacity, overlap in fixed if text else ():
                for no, (a, b, kind, run) in enumerate(bisect(text, capacity, overlap, places)):
                    pieces.append({"limit_id": limit_id, "piece_no": no, "start_pos": a, "end_pos": b, "cut": kind, "parted": run, "text": text[a:b]})
            rows.append((len(text), pieces))
        return pd.DataFrame(rows, columns=["n_chars", "pieces"])

    out = df.select(*keys, cut_up(source).alias("_r")).where("_r is not null")
    return out.select(*keys, "_r.n_chars", F.explode("_r.pieces").alias("_p")).select(*keys, "n_chars", "_p.*")
