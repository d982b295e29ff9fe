"""String rules: numbers in free replies, prompts, names of files and of products, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a decimal number looks like: fixed values (digits may be grouped by single underscores).
DECIMAL = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
WORDS = r"(?i)^[+-]?(?:nan|inf|infinity)$"
#: The question put to the text model.
PROMPT = (
    'Product title: "%s"\nShape category: %s\n\n'
    "How long is the longest side of this retail product in centimetres? Use amounts in the title to scale. "
    "Answer with one number only."
)
TRANSIENT = ("503", "429", "unavailable", "exhausted")


def parse_cm(raw: Column) -> Column:
    """The first plausible number of a reply, or null.

    The first token, without .,;: at its end and ~ or the almost-equal sign in front, if it is a decimal number; else the
    first digits with an optional fraction anywhere in the reply (so a sign in front of them is not seen).
    """
    trimmed = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    token = F.get(F.split(trimmed, r"(?U)\s+"), 0)
    token = F.regexp_replace(F.regexp_replace(token, "[.,;:]+$", ""), "^[~≈]+", "")
    plain = F.when(token.rlike(DECIMAL), F.replace(token, F.lit("_"), F.lit("")).try_cast("double"))
    word = F.lower(F.regexp_replace(token, r"^[+-]", ""))
    sign = F.when(token.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(word == "nan", float("nan")).otherwise(sign * float("inf"))
    anywhere = F.nullif(F.regexp_extract(raw, r"([0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")
    return F.when(trimmed == "", None).otherwise(F.coalesce(F.when(token.rlike(WORDS), special), plain, anywhere))


def size_prompt(title: Column, shape: Column, template: str = PROMPT) -> Column:
    return F.format_string(template, title, shape)


def image_name(scene: Column, camera: Column) -> Column:
    return F.format_string("images/%04d_%02d.png", scene, camera)


def overlay_name(file_name: Column) -> Column:
    return F.concat(F.lit("vis_"), F.replace(file_name, F.lit("/"), F.lit("_")))


def log_title(title: Column) -> Column:
    return F.substring(title, 1, 50)


def file_stem(path: Column) -> Column:
    """The last component without its extension; a leading dot is no extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def component_order(path: Column) -> Column:
    """Sort key that orders paths by their components, so a/x comes before a-b/x."""
    return F.split(path, "/")


def is_transient(message: Column) -> Column:
    return F.lower(message).rlike("|".join(TRANSIENT))


def backoff_seconds(attempt: Column) -> Column:
    """5, 10, 20 s after attempts 0, 1, 2."""
    return F.lit(5) * F.pow(F.lit(2), attempt).cast("long")


def truthy(value: Column) -> Column:
    """The value, or null where it is null or empty."""
    return F.nullif(value, F.lit(""))
