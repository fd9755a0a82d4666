"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space when a text is stripped or split; Java's \s lacks most of it.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAX_TOKENS = 4096


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(c: str | Column) -> Column:
    """True for a null text and for one of white space only."""
    return F.coalesce(~col(c).rlike(rf"[^{SPACE}]"), F.lit(True))


def words(c: str | Column) -> Column:
    """Lower-cased words between white space; none for a null text. Spaces are matched, not words: a split takes a third of the time."""
    return F.array_remove(F.split(F.lower(F.coalesce(col(c), F.lit(""))), f"[{SPACE}]+"), "")


def truncate(c: str | Column, most: int) -> Column:
    """The first `most` tokens, a token being a code point."""
    return F.substring(col(c), 1, most)


def token_estimate(c: str | Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(col(c)) / 4).cast("int")


def chunk_count(c: str | Column, most: int = MAX_TOKENS) -> Column:
    """How many chunks `even_chunks` makes of a text."""
    return F.when(F.octet_length(col(c)) <= most, F.lit(1)).otherwise(_parts(col(c), most))


def _parts(c: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / most)).cast("int")


def even_chunks(c: str | Column, most: int = MAX_TOKENS) -> Column:
    """Array of the chunks of a text: one where its bytes are at most `most`, else as few as needed and of even size."""
    c = col(c)
    parts = _parts(c, most)
    size = F.ceil(F.length(c) / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(c, i * size + 1, size))
    return F.when(F.octet_length(c) <= most, F.array(c)).otherwise(cut)


def titled(content: str | Column, title: str | Column) -> Column:
    """The content under its title, where that is a string with characters in it."""
    content, title = col(content), col(title)
    return F.when(F.length(title) > 0, F.concat(F.lit("Title: "), title, F.lit("\nContent: "), content)).otherwise(content)


def titled_variant(content: str | Column, metadata: str | Column) -> Column:
    """`titled` with the title of a VARIANT; a title that is not a string is none."""
    title = F.try_variant_get(col(metadata), "$.title", "variant")
    return titled(content, F.when(F.schema_of_variant(title) == "STRING", F.try_variant_get(col(metadata), "$.title", "string")))


def letters_only(c: str | Column) -> Column:
    """Letters and digits in lower case, nothing else."""
    return F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def strip_passage_suffix(c: str | Column) -> Column:
    """An id without its last two parts between hyphens."""
    return F.regexp_replace(col(c), "-[^-]*-[^-]*$", "")


def with_instruction(instruction: str | Column, query: str | Column) -> Column:
    """The query under an instruction and an empty line; alone where there is no instruction."""
    instruction, query = col(instruction), col(query)
    return F.when(is_blank(instruction), query).otherwise(F.concat(instruction, F.lit("\n\n"), query))


def mail_text(subject: Column, sent: Column, sender: Column, to: Column, cc: Column, bcc: Column, body: Column) -> Column:
    """A mail as one text: header lines, an empty line, the body."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    joined = lambda people: F.array_join(F.coalesce(people, F.array().cast("array<string>")), ", ")
    return F.concat_ws("\n", line("Subject", subject), line("Date", F.date_format(sent, "yyyy-MM-dd HH:mm:ss")), line("From", sender), line("To", joined(to)), line("Cc", joined(cc)), line("Bcc", joined(bcc)), F.lit(""), F.coalesce(body, F.lit("")))


def without_code_fence(c: str | Column) -> Column:
    """A model's reply without the Markdown fence around it."""
    return strip(F.regexp_replace(strip(c), r"^```[A-Za-z0-9_-]*\s*\n?|\n?\s*```$", ""))


def repaired_input(c: str | Column, most: int | None = None) -> Column:
    """What an embedder may be sent: one space for a blank text, at most `most` characters where it has a limit."""
    out = F.when(is_blank(c), F.lit(" ")).otherwise(col(c))
    return out if most is None else F.substring(out, 1, most)
