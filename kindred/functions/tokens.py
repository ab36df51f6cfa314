"""Numbers, tokens, n-grams, hashes and combinations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.text import DIGIT, WORD, tokens

# Words that say nothing about an address.
ADDRESS_GENERIC = ("road", "street", "avenue", "drive", "lane", "floor", "building", "block", "city", "district", "state", "country", "area", "plot", "unit", "shop")
ADDRESS_GENERIC_MORE = (*ADDRESS_GENERIC, "near", "opposite", "main", "north", "south", "east", "west")
ADDRESS_STOP = (
    "road", "rd", "street", "st", "lane", "ln", "avenue", "ave", "drive", "dr", "park", "building", "block", "floor", "unit", "city", "district",
    "state", "country", "private", "limited", "pvt", "ltd", "llc", "llp", "inc", "company", "corporation",
)

NONE = "array<string>"


def nothing() -> Column:
    return F.array().cast(NONE)


def found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def numbers(c: Column) -> Column:
    """Runs of digits with at most one letter behind, in order, with repeats."""
    return found(c, f"{DIGIT}+[a-zA-Z]?")


def postal_codes(c: Column) -> Column:
    """Four to six digits that are a word."""
    return found(c, f"(?<![{WORD}]){DIGIT}{{4,6}}(?![{WORD}])")


def digit_runs(c: Column) -> Column:
    """Distinct runs of ASCII digits."""
    return F.array_distinct(found(c, "[0-9]+"))


def has_digit(w: Column) -> Column:
    return w.rlike(DIGIT)


def address_tokens(c: Column, least: int = 4, generic: tuple[str, ...] = ADDRESS_GENERIC_MORE) -> Column:
    """X4, X5 (no generic words), X7 (least 3, no generic words): words with a digit or of at least so many characters."""
    keep = lambda w: has_digit(w) | (F.length(w) >= least)
    return F.filter(tokens(c), lambda w: keep(w) & ~w.isin(*generic) if generic else keep(w))


def strong_address_tokens(c: Column, least: int = 5) -> Column:
    """X6 but for the vocabulary, which is a semi join."""
    return F.filter(address_tokens(c, 4, ()), lambda w: ~w.isin(*ADDRESS_GENERIC) & (F.length(w) >= least))


def number_words(c: Column) -> Column:
    """A-z and 0-9 words that have a digit."""
    return F.filter(found(c, "[a-z0-9]+"), lambda w: w.rlike("[0-9]"))


def windows(text: Column, n: int) -> Column:
    """All runs of n characters; a shorter text is one, an empty text has none.

    Each match looks n characters ahead and takes one: a substring by its place would be sought from the text's beginning.
    """
    size = F.length(text)
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(size >= n, runs).when(size > 0, F.array(text)).otherwise(nothing())


def char_ngrams(c: Column, n: int = 3) -> Column:
    """N-grams of the text without spaces."""
    return windows(F.replace(c, F.lit(" "), F.lit("")), n)


def padded_ngrams(c: Column, n: int = 3) -> Column:
    """N-grams with spaces kept and one at either end; none of an empty text."""
    return F.when(F.length(c) > 0, windows(F.concat(F.lit(" "), c, F.lit(" ")), n)).otherwise(nothing())


def word_ngrams(c: Column, least: int = 2, most: int = 5) -> Column:
    """For every n from least to most, n-grams of each word with a space at either end; a shorter word gives one for the first such n only."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        w = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.greatest(F.length(w), F.lit(least))
        return F.concat(*[F.when(F.length(w) > n, windows(w, n)).when(size == n, F.array(w)).otherwise(nothing()) for n in range(least, most + 1)])

    return F.flatten(F.transform(words, of_word))


def crc(c: Column) -> Column:
    """X14."""
    return F.crc32(c)


def smallest_hashes(grams: Column, n: int) -> Column:
    """The n least distinct CRC-32 values."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(grams, lambda g: F.crc32(g)))), 1, n)


def first_distinct(words: Column, n: int) -> Column:
    """The first n distinct values in code point order."""
    return F.slice(F.array_sort(F.array_distinct(words)), 1, n)


def longest(words: Column, n: int) -> Column:
    """The n longest distinct words, in code point order where lengths tie."""
    keyed = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(F.slice(keyed, 1, n), lambda x: x["w"])


def pairs(words: Column, joined: str = "|") -> Column:
    """Each two of the words, in their order."""
    return F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.greatest(F.size(words), F.lit(1))), lambda b: F.concat_ws(joined, a, b))))


def sorted_pairs(words: Column, joined: str = "|") -> Column:
    """X19 with the two of each pair in code point order."""
    return F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.greatest(F.size(words), F.lit(1))), lambda b: F.concat_ws(joined, F.least(a, b), F.greatest(a, b)))))


def crossed(left: Column, right: Column, joined: str = "|") -> Column:
    """Each word of one with each of the other."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat_ws(joined, a, b))))


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def prefix_keys(name: Column) -> Column:
    """Prefixes of 3, 4 and 5 characters of the first word, of 4 and 5 of every word, and 5 of the first two joined; a prefix needs as many characters."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    cut = lambda n: lambda w: F.when(F.length(w) >= n, prefix(w, n))
    keys = [F.array(*[cut(n)(first) for n in (3, 4, 5)]), *[F.transform(words, cut(n)) for n in (4, 5)], F.array(cut(5)(F.concat(first, second)))]
    return F.array_distinct(F.array_compact(F.concat(*keys)))


def _two(words: Column, n: int) -> Column:
    """The first two words' prefixes, in code point order; null if there are fewer."""
    a, b = prefix(F.get(words, F.lit(0)), n), prefix(F.get(words, F.lit(1)), n)
    return F.when(b.isNotNull(), F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b)))


def name_signatures(name: Column, ascii_form: Column) -> Column:
    """First and last word, the first two, sorted word prefixes, and the first word and two in ASCII."""
    words, plain = tokens(name), tokens(ascii_form)
    first, last = F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))
    parts = F.slice(F.array_sort(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: prefix(w, 4))), 1, 4)
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(F.length(first) >= 3, F.concat(F.lit("FIRST:"), prefix(first, 5))),
                F.when(F.length(last) >= 3, F.concat(F.lit("LAST:"), prefix(last, 5))),
                F.concat(F.lit("PAIR:"), _two(words, 4)),
                F.when(F.size(parts) > 0, F.concat(F.lit("TOK:"), F.array_join(parts, "|"))),
                F.concat(F.lit("ASCII_FIRST:"), prefix(F.get(plain, F.lit(0)), 5)),
                F.concat(F.lit("ASCII_PAIR:"), _two(plain, 4)),
            )
        )
    )


def signature_words(address: Column) -> Column:
    """The words that tell something."""
    return F.filter(tokens(address), lambda w: has_digit(w) | ((F.length(w) >= 4) & ~w.isin(*ADDRESS_STOP)))


def address_signatures(nums: Column, words: Column) -> Column:
    """Numbers, words that tell something, the first of these and the first two, and long numbers."""
    return F.array_distinct(
        F.array_compact(
            F.concat(
                F.transform(nums, lambda x: F.concat(F.lit("NUM:"), x)),
                F.transform(words, lambda w: F.concat(F.lit("ADDR:"), prefix(w, 8))),
                F.array(F.concat(F.lit("ADDR_FIRST:"), prefix(F.get(words, F.lit(0)), 6)), F.concat(F.lit("ADDR_PAIR:"), _two(words, 5))),
                F.transform(F.filter(nums, lambda x: F.length(x) >= 5), lambda x: F.concat(F.lit("POST:"), x)),
            )
        )
    )


def id_list(c: Column) -> Column:
    """The parts of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def group_split(number: Column) -> Column:
    """One of ten by the CRC-32 of its decimal form is for validation."""
    return F.when(F.crc32(number.cast("string")) % 10 == 0, "valid").otherwise("train")


def packed(left: Column, right: Column, n: int) -> Column:
    """Two codes below n + 1 in one long."""
    return left.cast("long") * (n + 1) + right


def unpacked(code: Column, n: int) -> tuple[Column, Column]:
    return F.floor(code / (n + 1)).cast("long"), (code % (n + 1)).cast("long")
