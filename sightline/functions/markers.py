"""Word lists and patterns that decide how a question, hint or query is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import contains_any, let, normalize_phrase, squeeze

# Words of queries about structured pictures.
STRUCTURED_WORDS = [
    "chart",
    "graph",
    "table",
    "dashboard",
    "scoreboard",
    "diagram",
    "slide",
    "infographic",
    "timeline",
    "menu",
    "screen",
]

# Phrases that ask for every sound.
INVENTORY_PHRASES = [
    "distinct sound",
    "different sound",
    "sound effect",
    "sound effects",
    "audio cue",
    "audio cues",
    "non speech",
    "how many sounds",
    "what sounds",
    "which sounds",
    "various sounds",
]

# Order and time words of a question.
ORDER_WORDS = (
    r"\b(first|second|third|fourth|fifth|last|next|previous|before|after|earlier|later|between|during|while|when)\b"
)
ORDINAL_SLOT = r"\b(first|last|next|previous|earliest|latest)\b"

# Sound words, and an action that happens meanwhile.
SOUND_WORDS = r"\b(sound|sounds|noise|noises|audio|heard|listen|bang|beep|chirp|music)\b"
MEANWHILE_ACTION = (
    r"\b(when|while|during)\b.{0,80}\b(using|use|uses|used|doing|holding|showing|squeezing|pouring|opening|closing"
    r"|playing|touching|eating|drinking|wearing|carrying|handling)\b"
)

# Kinds of time hints.
EXACT_TIME = (
    r"(?i)\b\d{1,3}:\d{2}(?::\d{2})?(?:\.\d+)?\b"
    r"|\b(?:timestamp|time|at|around|near|second|sec)\s*(?:=|:)?\s*\d+(?:\.\d+)?\s*(?:seconds?|secs?|s)?\b"
    r"|\b\d+(?:\.\d+)?\s*(?:seconds?|secs?|s)\b"
)
ANCHOR_WORDS = (
    r"|\b(start|begin|opening|onset|first|end|finish|closing|last|middle|midpoint|center|centre)\b|\b\d+(?:\.\d+)?\s*%"
)
PLACEHOLDER_TIME = (
    r"(?i)\buse\s+the\s+timestamp\b|\btimestamp\s+of\s+the\b|\bnearest\s+transcript\s+span\b|\bphrase\s+match\b"
    r"|\basr\s+phrase\b|\bprevious\s+step\b|\btool\s+\d+\s+output\b"
)
SPEECH_WORDS = r"(?i)\b(asr|speech|spoken|utterance|dialogue|dialog|quote|quoted|phrase|transcript|line)\b"


def structured_query(query: Column) -> Column:
    return let({"w": normalize_phrase(query)}, lambda t: contains_any(t["w"], STRUCTURED_WORDS))


def audio_mode(query: Column) -> Column:
    """``inventory`` for a blank query or one that asks for every sound, else ``targeted``."""
    words = normalize_phrase(F.coalesce(query, F.lit("")))
    broad = let({"w": words}, lambda t: (t["w"] == "") | contains_any(t["w"], INVENTORY_PHRASES))
    return F.when(broad, "inventory").otherwise("targeted")


def question_tags(question: Column) -> Column:
    """Tags of a question: several order words, a relation, and an ordinal side of either."""

    def tags(t: Column) -> Column:
        ordinal = (t["several"] | t["relation"]) & t["low"].rlike(ORDINAL_SLOT)
        named = [(t["several"], "several_order_words"), (t["relation"], "relation"), (ordinal, "ordinal_slot")]
        return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for flag, name in named]))

    def read(t: Column) -> Column:
        low = t["low"]
        several = F.size(F.regexp_extract_all(low, F.lit(ORDER_WORDS), 1)) >= 2
        relation = contains_any(low, ["relation between", "relationship between"])
        return let({"low": low, "several": several, "relation": relation}, tags)

    return let({"low": F.lower(squeeze(question))}, read)


def conditioned_audio(text: Column) -> Column:
    """A sound asked for while some visible action goes on."""
    low = F.lower(squeeze(text))
    return let({"low": low}, lambda t: t["low"].rlike(SOUND_WORDS) & t["low"].rlike(MEANWHILE_ACTION))


def hint_flags(hint: Column) -> dict[str, Column]:
    return {
        "exact": hint.rlike(EXACT_TIME),
        "anchorable": hint.rlike(EXACT_TIME + ANCHOR_WORDS),
        "placeholder": hint.rlike(PLACEHOLDER_TIME),
        "speech": hint.rlike(SPEECH_WORDS),
    }


def is_image_artifact(kind: Column, media_type: Column, path: Column) -> Column:
    known = F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin("frame", "image", "screenshot")
    media = F.startswith(F.lower(F.trim(F.coalesce(media_type, F.lit("")))), F.lit("image/"))
    suffix = F.lower(F.trim(F.coalesce(path, F.lit("")))).rlike(r"\.(png|jpg|jpeg|webp|bmp)$")
    return known | media | suffix
