"""Text functions. All treat null as empty unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body uses it (also inside its lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(c: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and blank becomes a blank; blanks squeezed and stripped. ASCII only on purpose."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(cleaned, " +", " "))


def words(normalized: Column) -> Column:
    """Words of a normalised text; none for the empty text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def text_words(c: Column, digits: bool = True) -> Column:
    """words(normalize(c)), or of normalize(skeleton(c)) without digits, in one pass: all that is no word's sign parts words."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+" if digits else "[^a-z]+"), "")


def shingles(word_array: Column, n: int = 4) -> Column:
    """Distinct n-word shingles; a text of at most n words is one shingle, an empty text has none."""

    def cut(w: Column) -> Column:
        whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) <= n, whole).otherwise(F.array_distinct(many))

    return let(word_array, cut)


def grams(word_array: Column, n: int) -> Column:
    """Distinct n-word grams, none for shorter texts."""

    def cut(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(some))

    return let(word_array, cut)


def gram_hashes(word_array: Column, n: int) -> Column:
    """The distinct n-word grams as 64-bit hashes of their words, none for shorter texts: no gram is built as text."""

    def cut(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) < n, F.array().cast("array<bigint>")).otherwise(F.array_distinct(some))

    return let(word_array, cut)


def shingle_hashes(word_array: Column, n: int = 4) -> Column:
    """shingles() as sorted 64-bit hashes of their words: no shingle is built as text."""

    def cut(w: Column) -> Column:
        # Words that a short text does not have are null, which a hash leaves out.
        some = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(some)))

    return let(word_array, cut)


def skeleton(c: Column) -> Column:
    """The text with runs of digits, points and commas masked and white space squeezed."""
    masked = F.regexp_replace(F.coalesce(c, F.lit("")), "[0-9][0-9.,]*", "#")
    return F.trim(F.regexp_replace(masked, "[ \\t\\n\\r]+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def hash_hex(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by |: as text, ordered as the unsigned 64-bit number."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16)


def hash_int(*parts: Column) -> Column:
    """The same as an exact unsigned number."""
    return F.conv(hash_hex(*parts), 16, 10).cast("decimal(20,0)")


def hash_share(*parts: Column) -> Column:
    """A number in 0..9999 from the hash's first eight hex digits: for splits and samples."""
    return F.pmod(F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("long"), F.lit(10_000))


def base_id(c: Column) -> Column:
    return F.regexp_replace(c, "-p[0-9]+$", "")


def truncate_middle(c: Column, limit: int = 12_000) -> Column:
    """Texts over the limit keep their first two thirds and last third of it, with a counted marker between."""
    head, tail = limit * 2 // 3, limit - limit * 2 // 3
    cut = F.concat(F.substring(c, 1, head), F.lit("\n... ["), (F.char_length(c) - limit).cast("string"), F.lit(" characters omitted] ...\n"), F.right(c, F.lit(tail)))
    return F.when(F.char_length(c) > limit, cut).otherwise(c)


def length_bucket(c: Column) -> Column:
    n = F.char_length(F.coalesce(c, F.lit("")))
    return F.when(n < 300, "short").when(n < 900, "medium").otherwise("long")


def squeeze_value(c: Column) -> Column:
    """An extracted value without white space, commas and dollar signs, in lower case."""
    return F.lower(F.regexp_replace(c, "[ \\t\\n\\r,$]", ""))


#: Secrets and personal data that redaction masks, in order.
SECRETS = (
    ("bearer", "Bearer [A-Za-z0-9._-]{8,}"),
    ("key", "sk-[A-Za-z0-9]{8,}"),
    ("token", "token = \"[0-9a-f]+\""),
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    ("phone", "[+]?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -]?[0-9]{0,4}"),
)


def redact(c: Column, mask: str = "[REDACTED]") -> tuple[Column, Column]:
    """The text with every secret masked, and how many there were."""
    text, n = F.coalesce(c, F.lit("")), F.lit(0)
    for _, pattern in SECRETS:
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, mask)
    return text, n.cast("long")
