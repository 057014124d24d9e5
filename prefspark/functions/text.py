"""Column builders over transcripts, role headers and free-text replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role headers and reply patterns that the data formats prescribe.
HUMAN = "\n\nHuman: "
ASSISTANT = "\n\nAssistant: "
POST = "\n\nPOST: "
RESPONSE = "\n\nResponse: "
TURN_MARKS = ("\n\nHuman:", "\n\nAssistant:")
PROMPT_HEADER = "\nAssistant: "
LEGACY_ASSISTANT = "n\nAssistant: "
RATING_PATTERN = r"^\d+"
SCORE_LINE_PATTERN = r"^\s*([\d.]+)\s+([\d.]+)\s*$"
LABELLED_SCORE_PATTERN = r"(?:Assistant 1:|Assistant 2:)\s+(\d+)"
NO_SCORES = "0 0"

SCENARIOS = {
    "hh": (HUMAN, ASSISTANT),
    "shp": (POST, RESPONSE),
}


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_pattern(text: str) -> str:
    return rf"\Q{text}\E"


def count_literal(text: str | Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(_col(text), F.lit(literal_pattern(literal)))


def prompt_of_transcript(text: str | Column, header: str = PROMPT_HEADER) -> Column:
    """Everything up to and including the last header; the bare header where the text has none."""
    text = _col(text)
    reply = F.substring_index(text, header, -1)
    kept = F.left(text, F.length(text) - F.length(reply))
    return F.when(kept == "", F.lit(header)).otherwise(kept)


def split_parts(text: str | Column, header: str = ASSISTANT) -> Column:
    return F.split(_col(text), literal_pattern(header), -1)


def render_context(context: str | Column, mode: str) -> Column:
    """Context between its role headers. A mode naming ``hh-rlhf`` wins over one naming ``shp``."""
    context = _col(context)
    if "hh-rlhf" in mode:
        opening, closing = SCENARIOS["hh"]
    elif "shp" in mode:
        opening, closing = SCENARIOS["shp"]
    else:
        return F.lit("")
    return F.concat(F.lit(opening), context, F.lit(closing))


def rewrite_role_headers(text: str | Column, to: str) -> Column:
    """Headers of the other scenario replaced by those of ``to`` ('hh' or 'shp')."""
    text = _col(text)
    source = SCENARIOS["shp" if to == "hh" else "hh"]
    for old, new in zip(source, SCENARIOS[to]):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip_role_headers(
    text: str | Column,
    headers: Sequence[str] = (HUMAN, ASSISTANT, POST, RESPONSE),
    legacy_headers: bool = False,
) -> Column:
    """Text without role headers; ``legacy_headers`` keeps the historic literal that misses the assistant header."""
    text = _col(text)
    for header in headers:
        if legacy_headers and header == ASSISTANT:
            header = LEGACY_ASSISTANT
        text = F.replace(text, F.lit(header), F.lit(""))
    return text


def parse_rating(reply: str | Column) -> Column:
    """Leading integer of a reply as BIGINT, or null. No range check."""
    digits = F.nullif(F.regexp_extract(_col(reply), RATING_PATTERN, 0), F.lit(""))
    return digits.try_cast("bigint")


def parse_judge_scores(reply: str | Column) -> Column:
    """Two scores as text: the first line holding just two numbers, else every labelled value, else ``0 0``.

    The d and U flags make line ends and white space mean what the replies' producer means by them.
    """
    reply = _col(reply)
    line = "(?mdU)" + SCORE_LINE_PATTERN
    labelled = "(?U)" + LABELLED_SCORE_PATTERN
    return (
        F.when(
            F.regexp_like(reply, F.lit(line)),
            F.concat(F.regexp_extract(reply, line, 1), F.lit(" "), F.regexp_extract(reply, line, 2)),
        )
        .when(
            F.regexp_like(reply, F.lit(labelled)),
            F.array_join(F.regexp_extract_all(reply, F.lit(labelled), 1), " "),
        )
        .otherwise(F.lit(NO_SCORES))
    )


def has_judge_scores(reply: str | Column) -> Column:
    """False where :func:`parse_judge_scores` had to fall back, so that a true ``0 0`` stays distinguishable."""
    reply = _col(reply)
    return F.regexp_like(reply, F.lit("(?mdU)" + SCORE_LINE_PATTERN)) | F.regexp_like(
        reply, F.lit("(?U)" + LABELLED_SCORE_PATTERN)
    )


def words(text: str | Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(F.lower(_col(text)), r"\s+", -1), "")


def response_length(response: str | Column, context: str | Column | None = None) -> Column:
    """Hundreds of characters in the response."""
    return F.length(_col(response)) / F.lit(100.0)


def token_count(response: str | Column, context: str | Column | None = None) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(_col(response), F.lit(r"\S+")).cast("bigint")
