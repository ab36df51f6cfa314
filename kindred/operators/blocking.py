"""From keys to candidate pairs: caps, the key join and the count of agreeing signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text, tokens
from kindred.operators import sharing
from kindred.operators.keys import SIGNALS_CHAR, V4, Blocking, prepare, primary_keys, target_keys, vocabulary, vocabulary_by_band
from kindred.sources.work import materialize

#: Postings kept of a key where long postings are truncated.
KEEP = 300


def _by_signal(values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for sig, value in values.items():
        out = F.when(F.col("sig") == sig, value).otherwise(out)
    return out


def wanted(targets: DataFrame, primary: DataFrame) -> DataFrame:
    """The target keys that a primary record has."""
    return targets.join(primary.select("sig", "key").distinct(), ["sig", "key"], "left_semi")


def within_caps(keys: DataFrame, caps: dict[str, int], default: int = 300, by_hash: bool = False) -> DataFrame:
    """A2, A3, A5: the rows of keys that have no more postings than their signal's cap.

    Postings are counted with partial aggregation, so a key with a third of all rows is counted by
    many tasks; over-full keys are dropped before the join sees them. With ``by_hash`` a key counts
    whatever its signals, and the least of their caps holds.
    """
    cap, on = _by_signal(caps, default), ["key"] if by_hash else ["sig", "key"]
    counts = keys.groupBy(*on).agg(F.count("*").alias("n"), F.min(cap).alias("cap"))
    return keys.join(counts.where("n <= cap").select(*on), on, "left_semi")


def truncated(keys: DataFrame, keep: int = KEEP, order: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """A4: the first postings of each key in the given order.

    Two steps: within salted parts of a key, then among what these have left, so that an over-full
    key isn't sorted by one task.
    """
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("entity_id"), F.lit(32)))
    first = F.row_number().over(Window.partitionBy("sig", "key", "salt").orderBy(*order))
    some = salted.withColumn("place", first).where(F.col("place") <= keep).drop("salt", "place")
    return some.withColumn("place", F.row_number().over(Window.partitionBy("sig", "key").orderBy(*order))).where(F.col("place") <= keep).drop("place")


def candidates(primary: DataFrame, targets: DataFrame, signals: tuple[str, ...], by_hash: bool = False) -> DataFrame:
    """s1_id, target_id, mask, n_signals of every pair that shares a key; J2 with ``by_hash``: of any signal, and the primary record's signals count."""
    left = primary.select(F.col("entity_id").alias("s1_id"), "sig", "key")
    right = targets.select(F.col("entity_id").alias("target_id"), *([] if by_hash else ["sig"]), "key")
    bit = _by_signal({s: 1 << i for i, s in enumerate(signals)}, 0)
    pairs = left.join(right, ["key"] if by_hash else ["sig", "key"]).groupBy("s1_id", "target_id").agg(F.bit_or(bit).alias("mask"))
    return pairs.withColumn("n_signals", F.bit_count("mask").cast("int"))


def votes(primary: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, target_id, votes: shared keys, whatever their signal."""
    left = primary.select(F.col("entity_id").alias("s1_id"), "sig", "key")
    return left.join(targets.select(F.col("entity_id").alias("target_id"), "sig", "key"), ["sig", "key"]).groupBy("s1_id", "target_id").agg(F.count("*").alias("votes"))


def dealt(primary: DataFrame, targets: DataFrame, most: int = KEEP) -> tuple[DataFrame, DataFrame]:
    """Both sides with over-full keys split: a key's targets are dealt by their ids over parts of about ``most``, its primary records go to each of them."""
    posted = wanted(targets, primary)
    parts = posted.groupBy("sig", "key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    left = primary.join(parts, ["sig", "key"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = posted.join(parts, ["sig", "key"]).withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int"))
    return tuple(r.select("entity_id", "sig", F.struct("key", "part").alias("key")) for r in (left, right))


def shared_in_truth(truth: DataFrame, primary: DataFrame, targets: DataFrame) -> DataFrame:
    """J10 for keys of any fullness: the true pairs whose records share a key. The join starts at the truth, so no block is multiplied out."""
    left = truth.distinct().join(primary.select(F.col("entity_id").alias("s1_id"), "sig", "key"), "s1_id")
    return left.join(targets.select(F.col("entity_id").alias("target_id"), "sig", "key"), ["target_id", "sig", "key"], "left_semi").select("s1_id", "target_id").distinct()


def known_words(s1: DataFrame, config: Blocking) -> DataFrame | None:
    """The vocabulary that a generation's keys need, of prepared primary records."""
    if config.generation == "multi":
        from kindred.operators.keys import multi_words

        rows = multi_words(s1)
        return vocabulary_by_band(rows.select("entity_id", F.explode(F.concat("names", "addrs")).alias("word")))
    return vocabulary(s1) if config.generation in ("v1", "v3") else None


def sides(s1: DataFrame, targets: DataFrame, config: Blocking = V4) -> tuple[DataFrame, DataFrame]:
    """The keys of both sides, as entity_id, sig, key.

    The targets' keys are counted and then joined, so they are written once; texts are read once.
    """
    s1, targets = prepare(s1, config.how, config.strip_tld), prepare(targets, config.how, config.strip_tld)
    known = known_words(s1, config)
    return primary_keys(s1, config, known), materialize(target_keys(targets, config, known), "target-keys")


def block(s1: DataFrame, targets: DataFrame, config: Blocking = V4) -> DataFrame:
    """s1_id, target_id, mask, n_signals: the candidate pairs of primary and secondary records.

    The record tables have entity_id, business_name, business_address, country. Null texts count as
    empty and give no keys. The primary side isn't capped; adaptive execution splits its hot keys,
    each of which meets no more targets than its cap.
    """
    own, posted = sides(s1, targets, config)
    return candidates(own, within_caps(posted, config.caps, by_hash=config.by_hash), config.signals, config.by_hash)


def char_lists(records: DataFrame, how: str = "casefold") -> DataFrame:
    """entity_id, keys: the name without legal forms, its padded trigrams, address words and numbers, scoped by country."""
    name, address = text.name_without_phrases(F.col("business_name"), how), text.normalize_address(F.col("business_address"), how)
    rows = records.select("entity_id", text.country_fold(F.col("country"), how).alias("country"), name.alias("name"), address.alias("addr"))
    parts = {
        "exact_name": F.when(F.col("name") != "", F.array("name")).otherwise(tokens.nothing()),
        "char_name": tokens.padded_ngrams(F.col("name")),
        "addr_token": tokens.address_tokens(F.col("addr"), 3, ()),
        "addr_number": tokens.numbers(F.col("addr")),
    }
    keyed = lambda i: lambda p: sharing.key(i, F.col("country"), p)
    return rows.select("entity_id", F.concat(*[F.transform(F.array_distinct(parts[sig]), keyed(i)) for i, sig in enumerate(SIGNALS_CHAR)]).alias("keys"))


def char_candidates(s1: DataFrame, targets: DataFrame, cap: int = KEEP, how: str = "casefold") -> DataFrame:
    """s1_id, target_id, mask, n_signals of the union of four signals.

    Grams, words and numbers of more than ``cap`` targets are dropped, long lists of equal names are
    cut; by shared grams, and by shared words, each record keeps its first ``cap`` targets.
    """
    policy = {i: (sharing.CUT if sig == "exact_name" else sharing.CAP, cap) for i, sig in enumerate(SIGNALS_CHAR)}
    ranked = tuple(SIGNALS_CHAR.index(sig) for sig in ("char_name", "addr_token"))
    return sharing.counted(char_lists(s1, how), char_lists(targets, how), policy, sharing.Signals(len(SIGNALS_CHAR), ranked, cap))


def signature_lists(records: DataFrame, how: str = "casefold") -> DataFrame:
    """entity_id, keys of the prefix-signature generator, scoped by country."""
    normal = text.normalize_name(F.col("business_name"), how, suffixes=text.LEGAL_SUFFIXES_SIGNATURE)
    address, country = text.normalize_address(F.col("business_address"), how), text.country_fold(F.col("country"), how)
    rows = records.select("entity_id", country.alias("country"), normal.alias("name"), text.ascii_normalize(normal).alias("plain"), address.alias("addr"))
    rows = rows.withColumn("nums", tokens.numbers(F.col("addr"))).withColumn("words", tokens.signature_words(F.col("addr")))
    each = F.concat(tokens.name_signatures(F.col("name"), F.col("plain")), tokens.address_signatures(F.col("nums"), F.col("words")))
    return rows.select("entity_id", F.transform(F.array_distinct(each), lambda p: sharing.key(0, F.col("country"), p)).alias("keys"))


def signature_votes(s1: DataFrame, targets: DataFrame, keep: int = KEEP, k: int = KEEP, how: str = "casefold") -> DataFrame:
    """s1_id, target_id, votes, rank: postings cut at ``keep``, the first k targets by shared signatures."""
    return sharing.counted(signature_lists(s1, how), signature_lists(targets, how), {0: (sharing.CUT, keep)}, sharing.Votes(k))


def prefix_block_keys(records: DataFrame, country: str = "country") -> DataFrame:
    """entity_id, sig, key: the prefixes of the normalised name, scoped by country."""
    return records.select("entity_id", F.lit("pf").alias("sig"), F.explode(tokens.prefix_keys(text.normalize_text(F.col("business_name")))).alias("p"), country).select("entity_id", "sig", F.concat_ws("|", country, "p").alias("key"))


def prefix_lists(records: DataFrame, country: str = "country") -> DataFrame:
    """entity_id, keys: those of ``prefix_block_keys``."""
    return records.select("entity_id", F.transform(tokens.prefix_keys(text.normalize_text(F.col("business_name"))), lambda p: sharing.key(0, F.col(country), p)).alias("keys"))


def prefix_votes(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, target_id, votes of all prefix keys, however full."""
    return sharing.counted(prefix_lists(s1), prefix_lists(targets), {}, sharing.Votes())


def exact(s1: DataFrame, targets: DataFrame, on: list[Column], how: str = "inner") -> DataFrame:
    """s1_id, target_id of the records that agree in the given expressions; empty values never do."""
    named = [c.alias(f"k{i}") for i, c in enumerate(on)]
    keys = [f"k{i}" for i in range(len(on))]
    left = s1.select(F.col("entity_id").alias("s1_id"), *named).where(F.col(keys[-1]) != "")
    return left.join(targets.select(F.col("entity_id").alias("target_id"), *named).where(F.col(keys[-1]) != ""), keys, how).select("s1_id", "target_id")


def exact_normalized(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Same country as written and same name without trailing legal phrases."""
    return exact(s1, targets, [text.empty(F.col("country")), text.name_without_trailing(F.col("business_name"))])


def exact_name(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Same normalised name, whatever the country."""
    return exact(s1, targets, [text.normalize_text(F.col("business_name"))])


def exact_address(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Same country as written and same normalised address."""
    return exact(s1, targets, [text.empty(F.col("country")), text.normalize_text(F.col("business_address"))])


def transliterated_matches(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, target_id, probe: the target's transliterated name against the transliterated name, and the plain name, of the primary record."""
    plain = text.remove_suffixes(text.unicode_normalize(F.col("business_name")))
    spelled = text.remove_suffixes(text.transliterate(text.unicode_normalize(F.col("business_name")), "always"))
    country = text.country_fold(F.col("country"))
    index = targets.select(F.col("entity_id").alias("target_id"), country.alias("country"), spelled.alias("spelled")).where("spelled <> ''")
    probe = lambda c, name: s1.select(F.col("entity_id").alias("s1_id"), country.alias("country"), c.alias("spelled")).join(index, ["country", "spelled"]).select("s1_id", "target_id", F.lit(name).alias("probe"))
    return probe(spelled, "spelled").unionByName(probe(plain, "plain"))
