"""Blocking keys: records become rows (entity_id, sig, key).

A record table has entity_id, business_name, business_address and country; ``prepare`` adds the
normalised forms. What depends on the record alone is one projection and one explode; what depends
on frequencies (rare grams and tokens) is ranked per record, after a join with the counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text, tokens

# The signals in order (a signal's number is its bit), and how many postings a key may have.
SIGNALS_4 = ("nx", "ns", "nc", "ua", "aa", "ng", "nt", "ap", "ar", "an", "pc", "ag", "ah")
SIGNALS_3 = ("nx", "ns", "nc", "ua", "aa", "ng", "nt", "ap", "an", "pc", "ag", "ah")
SIGNALS_1 = ("nx", "ns", "nc", "ap", "an", "ua", "aa", "ng", "nt")
SIGNALS_AB = ("nx", "ns", "nc", "ua", "aa", "ng", "nt", "ap", "an")
SIGNALS_MULTI = ("nx", "ns", "nc", "np", "ap", "an", "xn")
SIGNALS_CHAR = ("exact_name", "char_name", "addr_token", "addr_number")
CAPS_4 = {"nx": 300, "ns": 300, "nc": 300, "ua": 300, "aa": 300, "ng": 150, "nt": 150, "ap": 200, "ar": 150, "an": 200, "pc": 300, "ag": 100, "ah": 200}
CAPS_3 = {"nx": 300, "ns": 300, "nc": 300, "ua": 300, "aa": 300, "ng": 150, "nt": 150, "ap": 200, "an": 200, "pc": 300, "ag": 100, "ah": 200}
CAPS_1 = dict.fromkeys(SIGNALS_1, 300)
CAPS_AB = dict.fromkeys(SIGNALS_AB, 300)
CAPS_MULTI = dict.fromkeys(SIGNALS_MULTI, 300)
#: Rare grams: at most so many records, so many grams; topped up to the wider limit if there are fewer than so many.
GRAM_RARE, GRAM_WIDE, GRAMS, GRAMS_ENOUGH = 500, 5000, 8, 5
TOKEN_RARE, TOKENS = 1000, 3
#: The vocabulary of the multi-signal generator: tokens of 1 to so many records.
VOCABULARY_MOST = 3000


@dataclass(frozen=True)
class Blocking:
    """One generation of blocking: its key generator, signals and caps.

    ``how`` is the case folding (``casefold`` or ``lower``), ``keyed`` how a key is held: ``xxhash64``,
    ``crc32`` (of the text with its signal) or ``text``. With ``by_hash`` keys meet whatever their
    signals, and a key that several signals have is capped by the least of their caps. With
    ``repeats`` a record's repeated keys count again toward the cap.
    """

    generation: str = "v4"
    signals: tuple[str, ...] = SIGNALS_4
    caps: dict[str, int] = field(default_factory=lambda: dict(CAPS_4))
    how: str = "casefold"
    keyed: str = "xxhash64"
    strip_tld: str = "never"
    by_hash: bool = False
    repeats: bool = False


V4 = Blocking()
V3 = Blocking("v3", SIGNALS_3, CAPS_3, keyed="crc32", by_hash=True, repeats=True)
V1 = Blocking("v1", SIGNALS_1, CAPS_1, keyed="crc32", by_hash=True, repeats=True)
#: The two sides of the transliteration experiment: with its signal, and without.
AB_SPELLED = Blocking("ab", SIGNALS_AB, CAPS_AB, keyed="crc32", by_hash=True, repeats=True)
AB_PLAIN = Blocking("ab", tuple(x for x in SIGNALS_AB if x != "nt"), CAPS_AB, keyed="crc32", by_hash=True, repeats=True)
MULTI = Blocking("multi", SIGNALS_MULTI, CAPS_MULTI)


def prepare(records: DataFrame, how: str = "casefold", strip_tld: str = "never") -> DataFrame:
    """entity_id, country, name, addr: folded country, name without legal forms, normalised address; raw_name, raw_addr."""
    return records.select(
        "entity_id",
        text.country_fold(F.col("country"), how).alias("country"),
        text.normalize_name(F.col("business_name"), how, strip_tld).alias("name"),
        text.normalize_address(F.col("business_address"), how).alias("addr"),
        text.empty(F.col("business_name")).alias("raw_name"),
        text.empty(F.col("business_address")).alias("raw_addr"),
    )


def _tagged(sig: str, payloads: Column) -> Column:
    return F.transform(payloads, lambda p: F.struct(F.lit(sig).alias("sig"), p.alias("payload")))


def _one(condition: Column, payload: Column) -> Column:
    return F.when(condition, F.array(payload)).otherwise(tokens.nothing())


def _ends(words: Column, cut: int | None) -> Column:
    first, last = F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))
    short = lambda w: tokens.prefix(w, cut) if cut else w
    return _one(F.length(first) >= 2, F.concat_ws("|", short(first), short(last)))


Makers = dict[str, Callable[[], Column]]


def name_keys(cut: int | None = None) -> Makers:
    """nx, ns, nc, ua of every generation; ``cut`` shortens the words of ua."""
    words, compact = F.col("name_words"), F.array_join(F.col("name_words"), "")
    return {
        "nx": lambda: _one(F.size(words) > 0, F.array_join(words, " ")),
        "ns": lambda: _one(F.size(words) > 0, F.array_join(F.array_sort(F.array_distinct(words)), " ")),
        "nc": lambda: _one(F.length(compact) >= 6, compact),
        "ua": lambda: _ends(words, cut),
        "aa": lambda: _ends(F.col("plain_words"), cut),
    }


def with_parts(records: DataFrame, config: Blocking) -> DataFrame:
    """Adds what the wanted signals' keys are made of, as columns of their own.

    So each is made once a record: an expression inside a lambda would be made again for every
    element. ``plain_words`` is of N2 of the name, ``spelled`` N3-N5 of it.
    """
    wanted, name, addr = set(config.signals), F.col("name"), F.col("addr")
    if wanted & {"nx", "ns", "nc", "ua"}:
        records = records.withColumn("name_words", tokens.tokens(name))
    if "aa" in wanted:
        records = records.withColumn("plain_words", tokens.tokens(text.ascii_normalize(name)))
    if "nt" in wanted:
        ascii_as = {"v1": "always", "ab": "always", "v3": "nothing"}.get(config.generation, "itself")
        records = records.withColumn("spelled", text.transliterate(name, ascii_as))
        if config.generation in ("v1", "ab"):
            clean = text.without(tokens.tokens(F.col("spelled")), text.LEGAL_SUFFIXES)
            records = records.withColumn("spelled", F.array_join(clean, " "))
    if "ag" in wanted:
        records = records.withColumn("addr_run", F.replace(addr, F.lit(" "), F.lit("")))
    if config.generation == "v4" and wanted & {"ap", "ar", "an", "ah"}:
        records = records.withColumn("nums", tokens.numbers(addr)) if wanted & {"an", "ah"} else records
        records = records.withColumn("strong", tokens.longest(tokens.address_tokens(addr), 5))
    return records


def _hashed(grams: Column, n: int) -> Column:
    return F.transform(tokens.smallest_hashes(grams, n), lambda h: h.cast("string"))


def _gated(condition: Column, payloads: Column) -> Column:
    return F.when(condition, payloads).otherwise(tokens.nothing())


def _address_grams() -> Column:
    return tokens.windows(F.col("addr_run"), 4)


def keys_4() -> Makers:
    """v4's keys of the record alone; ar as targets have it (the longest tokens)."""
    nums, strong = F.col("nums"), F.col("strong")
    return {
        **name_keys(),
        "ap": lambda: tokens.sorted_pairs(strong),
        "ar": lambda: F.slice(strong, 1, 3),
        "an": lambda: tokens.crossed(F.slice(nums, 1, 3), F.slice(strong, 1, 3)),
        "pc": lambda: tokens.postal_codes(F.col("addr")),
        "ag": lambda: _gated(F.length("addr_run") >= 8, tokens.first_distinct(_address_grams(), 4)),
        "ah": lambda: tokens.crossed(F.slice(nums, 1, 2), F.slice(strong, 1, 2)),
    }


def keys_3() -> Makers:
    """All signals of v3; addr_words and nums are its strong address tokens (after the vocabulary) and numbers, strong the longest five of the words."""
    words, nums, strong = F.col("addr_words"), F.col("nums"), F.col("strong")
    return {
        **name_keys(5),
        "ng": lambda: _hashed(tokens.char_ngrams(F.col("name"), 3), 8),
        "nt": lambda: _hashed(tokens.char_ngrams(F.col("spelled"), 3), 6),
        "ap": lambda: tokens.pairs(strong),
        "an": lambda: tokens.crossed(F.slice(nums, 1, 3), F.slice(words, 1, 3)),
        "pc": lambda: tokens.postal_codes(F.col("addr")),
        "ag": lambda: _gated(F.length("addr_run") >= 8, _hashed(_address_grams(), 4)),
        "ah": lambda: tokens.crossed(F.slice(nums, 1, 2), F.slice(strong, 1, 2)),
    }


def keys_1() -> Makers:
    """All signals of v1; useful and some are the first of its sorted distinct tokens and numbers (after the vocabulary)."""
    return {
        **name_keys(),
        "nt": lambda: _one(F.length("spelled") > 0, F.col("spelled")),
        "ng": lambda: _hashed(tokens.char_ngrams(F.col("name"), 4), 4),
        "ap": lambda: tokens.pairs(F.col("useful")),
        "an": lambda: tokens.crossed(F.col("some"), F.col("useful")),
    }


def keys_ab() -> Makers:
    """v1's signals without the vocabulary; nt is made of n-grams like ng, of the transliterated name."""
    return {**keys_1(), "nt": lambda: _hashed(tokens.char_ngrams(F.col("spelled"), 4), 4)}


def keyed(records: DataFrame, makers: Makers, config: Blocking) -> DataFrame:
    """entity_id, sig, key for each payload of the wanted signals; a record's repeated keys count once (within the row: no shuffle is needed for that) or, with ``repeats``, each time."""
    every = F.concat(*[_tagged(sig, make()) for sig, make in makers.items() if sig in config.signals])
    rows = records.select("entity_id", "country", F.explode(every if config.repeats else F.array_distinct(every)).alias("k"))
    return hashed(rows.select("entity_id", "country", "k.sig", "k.payload"), config)


def hashed(rows: DataFrame, config: Blocking) -> DataFrame:
    """(entity_id, country, sig, payload) -> (entity_id, sig, key)."""
    whole = F.concat_ws("|", "sig", "country", "payload")
    key = {"text": F.concat_ws("|", "country", "payload"), "crc32": F.crc32(whole), "xxhash64": F.xxhash64(whole)}[config.keyed]
    return rows.select("entity_id", "sig", key.alias("key"))


def frequencies(records: DataFrame, values: Column, name: str) -> DataFrame:
    """K1, K2: country, value, freq: records of a country that hold the value, counting each record once."""
    each = records.select("country", F.explode(F.array_distinct(values)).alias(name))
    return each.groupBy("country", name).agg(F.count("*").alias("freq"))


def gram_frequencies(records: DataFrame, n: int = 3) -> DataFrame:
    return frequencies(records, tokens.char_ngrams(F.col("name"), n), "gram")


def token_frequencies(records: DataFrame) -> DataFrame:
    return frequencies(records, tokens.address_tokens(F.col("addr")), "token")


def rare_grams(records: DataFrame, counts: DataFrame, name: Column | None = None, rare: int = GRAM_RARE, wide: int = GRAM_WIDE, most: int = GRAMS, enough: int = GRAMS_ENOUGH) -> DataFrame:
    """K3: entity_id, country, gram: of each record the rarest grams.

    Grams of at most ``rare`` records, by (freq, gram); if there are fewer than ``enough`` of them,
    those of at most ``wide`` in the same order fill up.
    """
    each = records.select("entity_id", "country", F.explode(F.array_distinct(tokens.char_ngrams(F.col("name") if name is None else name, 3))).alias("gram"))
    known = each.join(counts.where(F.col("freq") <= wide), ["country", "gram"])
    own = Window.partitionBy("entity_id")
    place = F.row_number().over(own.orderBy("freq", "gram"))
    n_rare = F.count_if(F.col("freq") <= rare).over(own)
    picked = known.withColumn("place", place).withColumn("n_rare", n_rare).where((F.col("place") <= most) & ((F.col("freq") <= rare) | (F.col("n_rare") < enough)))
    return picked.select("entity_id", "country", "gram", "freq")


def rare_tokens(records: DataFrame, counts: DataFrame, most: int = TOKEN_RARE, n: int = TOKENS) -> DataFrame:
    """K4: entity_id, country, token: the n rarest address tokens, longer ones first where they tie."""
    each = records.select("entity_id", "country", F.explode(F.array_distinct(tokens.address_tokens(F.col("addr")))).alias("token"))
    known = each.join(counts.where(F.col("freq") <= most), ["country", "token"])
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("freq", F.length("token").desc(), "token"))
    return known.withColumn("place", place).where(F.col("place") <= n).select("entity_id", "country", "token", "freq")


def vocabulary(records: DataFrame) -> DataFrame:
    """K5: the distinct address tokens that aren't generic, and numbers, of the primary records."""
    words = text.without(tokens.address_tokens(F.col("addr"), 4, ()), tokens.ADDRESS_GENERIC)
    return records.select(F.explode(F.concat(words, tokens.numbers(F.col("addr")))).alias("word")).distinct()


def vocabulary_by_band(words: DataFrame, least: int = 1, most: int = VOCABULARY_MOST) -> DataFrame:
    """K6: (entity_id, word) -> the words of ``least`` to ``most`` records."""
    return words.distinct().groupBy("word").agg(F.count("*").alias("df")).where(F.col("df").between(least, most))


def pruned(records: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """entity_id, column: the array's elements that are in the vocabulary, in their order."""
    each = records.select("entity_id", F.posexplode(column).alias("place", "word")).join(known.select("word"), "word", "left_semi")
    return each.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias(column))


def with_address_words(records: DataFrame, config: Blocking, known: DataFrame | None) -> DataFrame:
    """The tokens and numbers that v1, ab and v3 use, without what the vocabulary lacks (if there is one)."""
    addr, early = F.col("addr"), config.generation != "v3"
    if early:
        words = F.array_sort(F.array_distinct(text.without(tokens.address_tokens(addr, 4, ()), tokens.ADDRESS_GENERIC)))
        nums = F.array_sort(F.array_distinct(tokens.numbers(addr)))
    else:
        words, nums = tokens.strong_address_tokens(addr), tokens.numbers(addr)
    rows = records.withColumn("addr_words", words).withColumn("nums", nums)
    if known is not None:
        for column in ["addr_words", "nums"] if early else ["addr_words"]:
            left = pruned(rows, column, known)
            rows = rows.drop(column).join(left, "entity_id", "left").withColumn(column, F.coalesce(column, tokens.nothing()))
    if early:
        return rows.withColumn("useful", F.slice("addr_words", 1, 4)).withColumn("some", F.slice("nums", 1, 2))
    return rows.withColumn("strong", tokens.longest(F.col("addr_words"), 5))


def multi_words(records: DataFrame) -> DataFrame:
    """entity_id, country, and the sorted words of name (a) and address (b) of the multi-signal generator, before the vocabulary."""
    name, addr = tokens.found(text.ascii_name(F.col("raw_name")), "[a-z0-9]+"), tokens.found(text.ascii_normalize(F.col("raw_addr")), "[a-z0-9]+")
    return records.select("entity_id", "country", name.alias("names"), addr.alias("addrs"))


def with_multi_words(records: DataFrame, known: DataFrame) -> DataFrame:
    """name_words, and at most 8 name words (nv), 8 address words (av) and 4 numbers (dv) that the vocabulary has."""
    rows = multi_words(records)
    sorted_ = lambda c, keep: F.array_sort(F.array_distinct(F.filter(c, keep)))
    rows = rows.withColumn("nv", sorted_(F.col("names"), lambda w: F.length(w) >= 3))
    rows = rows.withColumn("av", sorted_(F.col("addrs"), lambda w: (F.length(w) >= 4) & w.rlike("^[a-z]+$")))
    rows = rows.withColumn("dv", sorted_(F.col("addrs"), lambda w: (F.length(w) >= 2) & w.rlike("[0-9]")))
    for column, n in (("nv", 8), ("av", 8), ("dv", 4)):
        kept = pruned(rows, column, known).withColumnRenamed(column, "kept")
        rows = rows.join(kept, "entity_id", "left").withColumn(column, F.slice(F.coalesce("kept", tokens.nothing()), 1, n)).drop("kept")
    return rows.withColumnRenamed("names", "name_words")


def keys_multi() -> Makers:
    """nx, ns, nc, np, ap, an, xn: combinations of name words, address words and numbers."""
    names = {k: m for k, m in name_keys().items() if k in ("nx", "ns", "nc")}
    return {
        **names,
        "np": lambda: tokens.pairs(F.col("nv")),
        "ap": lambda: tokens.pairs(F.col("av")),
        "an": lambda: tokens.crossed(F.col("dv"), F.col("av")),
        "xn": lambda: tokens.crossed(F.col("nv"), F.col("dv")),
    }


def _early_keys(records: DataFrame, config: Blocking, known: DataFrame | None) -> DataFrame:
    """Keys of every generation but v4; the vocabulary is that of this side."""
    if config.generation == "multi":
        return keyed(with_multi_words(records, known), keys_multi(), config)
    rows = with_address_words(with_parts(records, config), config, known)
    return keyed(rows, {"v1": keys_1, "ab": keys_ab, "v3": keys_3}[config.generation](), config)


def primary_keys(records: DataFrame, config: Blocking = V4, known: DataFrame | None = None) -> DataFrame:
    """Keys of the primary records (source 1), already prepared."""
    if config.generation != "v4":
        return _early_keys(records, config, None if config.generation == "v1" else known)
    records, wanted = with_parts(records, config), set(config.signals)
    tagged = lambda rows, sig, column: rows.select("entity_id", "country", F.lit(sig).alias("sig"), F.col(column).alias("payload"))
    found = []
    if wanted & {"ng", "nt"}:
        grams = gram_frequencies(records)
        found += [tagged(rare_grams(records, grams, F.col(c)), sig, "gram") for sig, c in (("ng", "name"), ("nt", "spelled")) if sig in wanted]
    if "ar" in wanted:
        found.append(tagged(rare_tokens(records, token_frequencies(records)), "ar", "token"))
    own = {k: m for k, m in keys_4().items() if k != "ar"}
    out = [keyed(records, own, config)] if wanted & own.keys() else []
    return reduce(DataFrame.unionByName, [*out, *(hashed(rows, config) for rows in found)])


def target_keys(records: DataFrame, config: Blocking = V4, known: DataFrame | None = None) -> DataFrame:
    """Keys of the secondary records (sources 2 and 3), already prepared."""
    if config.generation != "v4":
        return _early_keys(records, config, known)
    grams = lambda c: lambda: F.array_distinct(tokens.char_ngrams(F.col(c), 3))
    return keyed(with_parts(records, config), {**keys_4(), "ng": grams("name"), "nt": grams("spelled")}, config)
