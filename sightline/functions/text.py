"""Text column functions (JVM-side, but for the redaction of JSON records)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set that trimming must treat as blank.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(parts: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``parts`` once per row and use them in ``body`` as often as needed."""
    row = F.struct(*[c.alias(n) for n, c in parts.items()])
    return F.transform(F.array(row), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_phrase(c: Column) -> Column:
    """Lower-case words of letters and digits with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def truncate_text(c: Column, limit: int = 220, mark: str = "...", squeezed: bool = True) -> Column:
    def cut(t: Column) -> Column:
        head = F.rtrim(F.substring(t["t"], 1, limit - len(mark)), F.lit(WS_CHARS))
        return F.when(F.length(t["t"]) <= limit, t["t"]).otherwise(F.concat(head, F.lit(mark)))

    return let({"t": squeeze(c) if squeezed else strip(c)}, cut)


def is_low_signal(c: Column) -> Column:
    """Empty, no letter or digit at all, or one character repeated eight times and more (white space, then also marks and case, left out)."""
    said = F.coalesce(c, F.lit(""))
    other = r"[^\p{L}\p{N}]*"
    same_sign = rf"(?s)^{WS}*([^{WS[1:-1]}])(?:{WS}*\1){{7,}}{WS}*$"
    same_letter = rf"(?s)^{other}([\p{{L}}\p{{N}}])(?:{other}\1){{7,}}{other}$"
    return ~said.rlike(r"[\p{L}\p{N}]") | said.rlike(same_sign) | F.lower(said).rlike(same_letter)


def is_meaningful(c: Column) -> Column:
    words = F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), 0)
    letters = F.length(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))
    return ~is_low_signal(c) & ((letters >= 6) | (F.size(words) >= 2))


def contains_any(c: Column, markers: list[str]) -> Column:
    test = F.lit(False)
    for marker in markers:
        test = test | F.contains(c, F.lit(marker))
    return test


def sentence_chunks(c: Column) -> Column:
    """Sentences: cut at semicolons and newlines, and at the space after . ! ?"""
    parts = F.split(c, r"[;\n]+|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


#: Stands between pieces while a text is cut: a code point that is no character and so in no text.
MARK = "\ufdd0"


def atomic_pieces(c: Column) -> Column:
    """Sentences cut further at commas before a word and at the words and / but; repeats are kept.

    The text is marked where it is cut, rule by rule, and split once: a handful of expressions per text, none per piece.
    Spaces, commas and semicolons beside a mark belong to no piece, so a word that leads a piece does not cut it.
    """
    tidy = rf"[ ,;]*+{MARK}[ ,;{MARK}]*+"
    other_space = WS_CHARS.replace(" ", "")
    marked = F.regexp_replace(c, r"[;\n]+|(?<=[.!?])\s+", MARK)
    squeezed = F.regexp_replace(F.translate(marked, other_space, " " * len(other_space)), "  +", " ")
    marked = F.regexp_replace(squeezed, r", (?=[A-Za-z0-9])", MARK)
    marked = F.btrim(F.regexp_replace(marked, tidy, MARK), F.lit(f" ,;{MARK}"))
    marked = F.regexp_replace(marked, r" (?:and|but) ", MARK)
    marked = F.btrim(F.regexp_replace(marked, tidy, MARK), F.lit(f" ,;{MARK}"))
    return F.filter(F.split(marked, MARK), lambda s: s != "")


def distinct_casefold(texts: Column) -> Column:
    """Distinct texts of a short array, ignoring case; the first spelling stays."""

    def first_of_kind(b: Column) -> Column:
        return F.filter(b["t"], lambda t, i: F.array_position(b["low"], F.lower(t)) == i + 1)

    return let({"t": texts}, lambda b: let({"t": b["t"], "low": F.transform(b["t"], F.lower)}, first_of_kind))


def numeric_from_text(c: Column) -> Column:
    """First number of a text; thousands commas are dropped and the sign is ignored."""
    digits = F.regexp_extract(c, r"[-+]?\$?\s*(\d+(?:,\d{3})*(?:\.\d+)?|\.\d+)\s*%?", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def step_number(c: Column) -> Column:
    """Last digit run of a step id; zero or none gives null."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+"), 0)
    number = F.try_element_at(runs, F.lit(-1)).try_cast("long")
    return F.nullif(number, F.lit(0))


# Words for a confidence and words that mean "none given".
CONFIDENCE_WORDS = {
    "very low": 0.1,
    "low": 0.25,
    "medium": 0.5,
    "moderate": 0.5,
    "high": 0.85,
    "very high": 0.95,
}


def coerce_confidence(c: Column) -> Column:
    """Number, percentage or word to a value in [0, 1]; anything else is null."""
    text = F.lower(strip(c))
    words = F.create_map(*[F.lit(x) for pair in CONFIDENCE_WORDS.items() for x in pair])
    percent = strip(F.regexp_replace(text, "%$", "")).try_cast("double") / 100.0
    number = (
        F.when(F.map_contains_key(words, text), F.try_element_at(words, text))
        .when(F.endswith(text, F.lit("%")), percent)
        .otherwise(text.try_cast("double"))
    )
    return F.when((number >= 0.0) & (number <= 1.0), number)


# Path suffixes per media type.
MEDIA_SUFFIXES = {
    "image": ["png", "jpg", "jpeg", "bmp", "webp"],
    "video": ["mp4", "mkv", "mov", "webm"],
    "audio": ["wav", "mp3", "flac"],
    "application/json": ["json"],
    "text/plain": ["txt", "md", "jsonl"],
}


def media_type_of(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"[^/.]\.([^./]+)$", 1)
    kind = F.lit(None).cast("string")
    for media, suffixes in MEDIA_SUFFIXES.items():
        kind = F.when(suffix.isin(suffixes), F.lit(media)).otherwise(kind)
    return kind


def sanitize_component(c: Column, limit: int = 120) -> Column:
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9._-]+", "_")
    text = F.regexp_replace(text, "^[._-]+|[._-]+$", "")
    return F.substring(F.when(text == "", F.lit("item")).otherwise(text), 1, limit)


def redact_paths(c: Column, root: str | None = None) -> Column:
    """Absolute paths become relative to ``root`` when inside it, else ``<redacted-path>``."""
    path = r"(?<![A-Za-z0-9._-])/(?:[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*)"
    text = c
    if root:
        inside = root.rstrip("/")
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9._-])\Q{inside}\E/(?=[A-Za-z0-9._-])", "")
    scrubbed = F.regexp_replace(text, path, "<redacted-path>")
    return F.when(F.startswith(text, F.lit("/")), F.lit("<redacted-path>")).otherwise(scrubbed)


# Keys that name a place on a disk.
PATH_KEYS = ["source_path", "video_path", "frame_path", "path"]


def redact_record(c: Column, root: str | None = None) -> Column:
    """JSON text with the path keys dropped at any depth and ``redact_paths`` applied to every string, keys in order.

    What is no JSON is null.
    """
    path = re.compile(r"(?<![A-Za-z0-9._-])/(?:[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*)")
    inside = re.compile(rf"(?<![A-Za-z0-9._-]){re.escape(root.rstrip('/'))}/(?=[A-Za-z0-9._-])") if root else None
    dropped = set(PATH_KEYS)

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if k not in dropped}
        if isinstance(value, list):
            return [clean(v) for v in value]
        if not isinstance(value, str):
            return value
        shown = inside.sub("", value) if inside else value
        return "<redacted-path>" if shown.startswith("/") else path.sub("<redacted-path>", shown)

    def one(raw):
        try:
            return json.dumps(clean(json.loads(raw)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def redacted(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return redacted(c)


def parse_list_field(c: Column) -> Column:
    """JSON list, JSON object (values by key), text cut at ``||``, or one text; blank items dropped."""
    text = strip(c)
    from_list = F.from_json(text, "array<string>")
    pairs = F.map_entries(F.from_json(text, "map<string,string>"))
    from_object = F.transform(F.array_sort(pairs), lambda e: e["value"])
    parts = (
        F.when(F.startswith(text, F.lit("[")), F.coalesce(from_list, F.array(text)))
        .when(F.startswith(text, F.lit("{")), F.coalesce(from_object, F.array(text)))
        .otherwise(F.split(text, r"\|\|"))
    )
    cleaned = F.filter(F.transform(parts, strip), lambda s: s != "")
    return F.when(F.size(cleaned) > 0, cleaned)


def quotes(c: Column) -> Column:
    """Quoted texts of three characters and more, those in double quotes first.

    A single quote closes only when no letter or digit follows it.
    """
    double = F.regexp_extract_all(c, F.lit(r'"([^"\n]{3,})"'), 1)
    single = F.regexp_extract_all(c, F.lit(r"(?s)'(.*?)'(?![\p{L}\p{N}])"), 1)
    long = F.filter(F.transform(single, strip), lambda s: F.length(s) >= 3)
    return F.concat(F.filter(F.transform(double, strip), lambda s: s != ""), long)


def band(scores):
    """Scores as text to whole bands 1..5, ties to the even side; what is no number is left out."""
    numbers = F.map_filter(F.transform_values(scores, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    return F.transform_values(numbers, lambda _, v: F.greatest(F.lit(1), F.least(F.lit(5), F.bround(v).cast("int"))))


def verdict(c):
    word = F.upper(strip(c))
    return F.when(word.isin("PASS", "FAIL"), word).otherwise(F.lit("FAIL"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_options(choices, gold_index):
    """``A. text`` for the choices that are not blank, lettered by their place among all choices.

    The gold index counts after the blanks are gone.
    """

    def lettered(c, i):
        named = F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), strip(c))
        return F.when(strip(c) != "", named)

    options = F.array_compact(F.transform(choices, lettered))
    gold = F.when(gold_index >= 0, F.try_element_at(options, (gold_index + 1).cast("int")))
    return F.struct(options.alias("options"), gold.alias("gold"))
