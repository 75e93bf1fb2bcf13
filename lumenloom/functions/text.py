"""Caption functions on columns; all of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, as the inside of a character class.
SPACES = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stock openings of captions, in the order in which they are tried.
OPENINGS = (
    "The image shows a painting of ",
    "The image shows a drawing of ",
    "The image shows ",
    "In the image, ",
    "In the picture, ",
    "The image depicts ",
    "The image features ",
)
#: The chat prompt around a caption.
SYSTEM_PROMPT = "Describe the image, focusing on its content, artistic style, composition, lighting, color, texture, and the spatial relationships between objects and the background:"
CHAT = "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n"


def strip(text: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACES}]+"))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word for a text that begins with a plain Latin letter, else 0.6 a character, cut to whole tokens; 0 for null and empty texts."""
    latin = text.rlike("^[a-zA-Z]")
    guess = F.when(latin, (word_count(text) * F.lit(1.3)).cast("int")).otherwise((F.length(text) * F.lit(0.6)).cast("int"))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(guess)


def capitalize(text: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def clean_caption(text: Column) -> Column:
    """Without one stock opening and without triple quotes, stripped and capitalised; null becomes empty."""
    opened = F.regexp_replace(text, "^(?:" + "|".join(map(re.escape, OPENINGS)) + ")", "")
    unquoted = F.replace(F.replace(opened, F.lit('"""'), F.lit("")), F.lit("'''"), F.lit(""))
    return F.coalesce(capitalize(strip(unquoted)), F.lit(""))


def artist_title(name: Column) -> Column:
    """Dashes as blanks, each run of cased letters with a capital first letter; ß at a beginning becomes Ss."""
    runs = F.regexp_extract_all(F.replace(name, F.lit("-"), F.lit(" ")), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    cap = lambda r: F.when(F.substring(r, 1, 1) == "ß", F.concat(F.lit("Ss"), F.lower(F.substring(r, 2, 1 << 30)))).otherwise(capitalize(r))
    return F.array_join(F.transform(runs, cap), "")


def chat_prompt(text: Column) -> Column:
    before, after = CHAT.replace("{system}", SYSTEM_PROMPT).split("{user}")
    return F.concat(F.lit(before), text, F.lit(after))


def numbered_prompts(prompts: Column, limit: int = 32) -> Column:
    """The first limit texts, one line each, numbered, with blank lines between and a count of the rest; empty for an empty list."""
    shown = F.slice(prompts, 1, limit)
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), strip(F.replace(x, F.lit("\n"), F.lit(" "))))
    lines = F.array_join(F.transform(shown, line), "\n\n")
    more = F.when(F.size(prompts) > limit, F.concat(F.lit("\n\n... (+"), (F.size(prompts) - limit).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.size(prompts) > 0, F.concat(lines, more)).otherwise("")


def second_or_first(captions: Column, skip_empty: bool = False) -> Column:
    """The second caption of a list of several (if skip_empty, unless it is null or empty), else the first; null for an empty list."""
    first, second = F.try_element_at(captions, F.lit(1)), F.try_element_at(captions, F.lit(2))
    use = F.coalesce(second, F.lit("")) != "" if skip_empty else F.size(captions) > 1
    return F.when(use, second).otherwise(first)


def location_parts(url: Column, scheme: str) -> Column:
    """struct(place, file): the first two parts behind a scheme, and the rest; null for texts without the scheme or a file."""
    parts = F.split(F.substring(url, len(scheme) + 1, 1 << 30), "/")
    whole = url.startswith(scheme) & (F.size(parts) > 2)
    return F.when(whole, F.struct(F.array_join(F.slice(parts, 1, 2), "/").alias("place"), F.array_join(F.slice(parts, 3, 1 << 20), "/").alias("file")))


def step_name(step: Column) -> Column:
    return F.format_string("step_%06d", step)


def bucket_name(bucket: Column, width: Column, height: Column) -> Column:
    return F.format_string("bucket%d_%dx%d", bucket, height, width)


def block_of(key: Column, prefix: str) -> Column:
    """The number of the block to which a parameter belongs, from keys like prefix.7.name with or without a leading 'module.'; else null."""
    bare = F.regexp_replace(key, r"^module\.", "")
    return F.when(bare.startswith(prefix + "."), F.split_part(bare, F.lit("."), F.lit(2)).try_cast("int"))
