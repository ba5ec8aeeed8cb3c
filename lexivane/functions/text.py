"""Column functions on text and tokens."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivane import config

Normaliser = Callable[[Column], Column]

# Unicode white space plus the four separators that also count as blank.
_BLANK = r"[\s\x1c-\x1f]"


def words(text: Column) -> Column:
    """Lower-cased runs of word characters, accents included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def strip(text: Column) -> Column:
    """Text without blanks at its ends; one that has none there is not searched for them."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    stripped = F.regexp_replace(text, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")
    return F.when(ends.rlike(rf"(?U){_BLANK}"), stripped).otherwise(text)


def lower_case(text: Column) -> Column:
    return F.lower(text)


def remove_accents(text: Column) -> Column:
    """Plain letters for accented lower-case ones; æ, ø and å stay."""
    return F.translate(text, config.ACCENTED, config.UNACCENTED)


def prepend_instruction(instruction: str) -> Normaliser:
    return lambda text: F.concat(F.lit(instruction + " "), text)


def compose(*normalisers: Normaliser | None) -> Normaliser:
    """Apply the normalisers left to right; None stands for identity."""
    steps = [n for n in normalisers if n is not None]
    return lambda text: reduce(lambda done, step: step(done), steps, text)


def detailed_instruct(query: Column, quoted: bool = True) -> Column:
    quote = "'" if quoted else ""
    return F.concat(
        F.lit(f"{quote}Instruct: {config.EMBED_INSTRUCTION}\nQuery: "), query, F.lit(quote)
    )


def danish_detailed_instruct(query: Column) -> Column:
    return F.concat_ws(" ", F.lit(config.DANISH_INSTRUCTION), query)


def add_instruction(column: Column, document: Column, instruction: str) -> Column:
    """Separator-prefixed text; queries carry the instruction in front of it."""
    plain = F.concat(F.lit(config.INSTRUCTION_SEPARATOR), document)
    if not instruction:
        return plain
    prefix = F.lit(f"{instruction.strip()} {config.INSTRUCTION_SEPARATOR}")
    return F.when(column == "query", F.concat(prefix, document)).otherwise(plain)


def encoding_pair(column: Column, document: Column, instruction: str) -> Column:
    """The (instruction, text) pair an instruction-aware encoder takes."""
    given = F.when(column == "query", F.lit(instruction)).otherwise(F.lit(""))
    return F.struct(given.alias("instruction"), document.alias("text"))


def token_input(token: Column, instruction: str | None = None) -> Column:
    if instruction is None:
        return token
    return F.struct(F.lit(instruction).alias("instruction"), token.alias("text"))


def resolved_to_unknown(
    is_internal: Column, token: Column, resolved: Column, unknown: str = config.UNKNOWN_TOKEN
) -> Column:
    """Internal tokens that the vocabulary turns into the unknown token."""
    return is_internal & (resolved == unknown) & (token != unknown)


def legend_label(text: Column, width: int = 30) -> Column:
    cut = F.concat(F.substring(text, 1, width), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(text)


def fits_length(n_tokens: Column, max_length: int, doc_max_length: int) -> Column:
    """Token count, as truncated at max_length, within doc_max_length."""
    return F.least(n_tokens, F.lit(max_length)) <= doc_max_length


def removal_pattern(
    strip_upper_case: bool = False, strip_exotic: bool = False, strip_uncommon: bool = False
) -> str:
    """The default removal pattern and the enabled ones, as alternatives."""
    extra = [
        (strip_upper_case, config.UPPER_CASE_PATTERN),
        (strip_exotic, config.EXOTIC_PATTERN),
        (strip_uncommon, config.UNCOMMON_PATTERN),
    ]
    return "|".join([config.DEFAULT_PATTERN] + [pattern for on, pattern in extra if on])


def is_removed(token: Column, pattern: str) -> Column:
    """True where the pattern matches at the start of the token."""
    return token.rlike(f"(?Ud)^(?:{pattern})")


def validate_parameters(
    apply_zipf: bool | None, sif_coefficient: float | None, token_remove_pattern: str | None
) -> tuple[float | None, str | None]:
    """Resolve the weighting switches and check the removal pattern.

    The zipf switch wins over the coefficient: off means no weighting, on
    without a coefficient means the zipf default.
    """
    if apply_zipf is False:
        sif_coefficient = None
    elif apply_zipf and sif_coefficient is None:
        sif_coefficient = config.ZIPF_SIF_COEFFICIENT
    if sif_coefficient is not None and not 0 < sif_coefficient < 1:
        raise ValueError("the SIF coefficient must lie strictly between 0 and 1")
    if token_remove_pattern is not None:
        try:
            re.compile(token_remove_pattern)
        except re.error as error:
            raise ValueError(f"not a regular expression: {token_remove_pattern!r}") from error
    return sif_coefficient, token_remove_pattern


# Run-label pieces in order. A parameter is named only where it
# differs from its default; {} takes the value.
RUN_LABELS = {
    "vocab_size": (config.VOCAB_SIZE, "vocab{}"),
    "sif_coefficient": (config.SIF_COEFFICIENT, "sif{}"),
    "test_size": (config.TEST_SIZE, "test{}"),
    "random_state": (config.RANDOM_STATE, "seed{}"),
    "full_dataset_training": (False, "full"),
    "evaluate": (True, "noeval"),
    "strip_upper_case": (False, "strip_upper_case"),
    "strip_exotic": (False, "strip_exotic"),
    "strip_uncommon": (False, "strip_uncommon"),
    "prenormalize_embeddings": (False, "prenormalize_embeds"),
    "prePCAnormalize_embeddings": (False, "prePCAnormalize_embeds"),
    "focus_pca": (False, "focus_pca"),
    "stem": (False, "stem"),
    "normalize_embeddings": (False, "normalize_embeddings"),
    "ignore_external_tokens": (False, "ignore_external_tokens"),
}


def run_label(output_dim: Column, columns: list[str]) -> Column:
    """Run name from the parameter columns that are present and not default."""
    parts = [F.concat(F.lit("dim"), output_dim.cast("string"))]
    for name, (default, label) in RUN_LABELS.items():
        if name in columns:
            value = F.col(name)
            text = F.format_string(label.replace("{}", "%s"), value.cast("string")) if "{}" in label else F.lit(label)
            parts.append(F.when(value != F.lit(default), text))
    return F.concat_ws("_", *parts)
