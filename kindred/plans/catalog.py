"""The registered linkage queries and their DuckDB counterparts.

Queries with a counterpart fold case with ``lower``, which both engines share, and hold keys as
text. Those without need Unicode normal forms, a longest common subsequence or a fitted model; they
are held against golden rows and plain Python in the tests.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text, tokens
from kindred.operators import blocking, diagnosis, evaluation, features, keys, nearest, profiling, ranking, sampling, training
from kindred.plans import proxy
from kindred.plans.proxy import ORDERS, REC, TRUTH, split_sql, words_sql
from kindred.session import shipped
from kindred.sources import tables
from kindred.sources.work import materialize

LOWER = dataclasses.replace(keys.V4, how="lower", keyed="text", signals=("nx", "ns", "nc", "ua", "ng", "ap", "ar", "an", "pc", "ag", "ah"))
PAIRS = ["s1_id", "target_id", "n_signals"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL parts ---------------------------------------------------------------------------------

_SUFFIXES = ", ".join(f"'{w}'" for w in text.LEGAL_SUFFIXES)
_GENERIC = ", ".join(f"'{w}'" for w in tokens.ADDRESS_GENERIC_MORE)
NORM = f"""norm AS (
  SELECT entity_id, src, trim(lower(coalesce(country, ''))) AS country,
    list_filter({split_sql(words_sql("business_name"))}, lambda w: w NOT IN ({_SUFFIXES})) AS nt,
    {words_sql("business_address")} AS addr FROM rec
), base AS (
  SELECT *, array_to_string(nt, ' ') AS name, {split_sql("addr")} AS aw, regexp_extract_all(addr, '\\p{{Nd}}+[a-zA-Z]?') AS nums FROM norm
), tok AS (
  SELECT *, list_filter(aw, lambda w: (regexp_matches(w, '\\p{{Nd}}') OR length(w) >= 4) AND w NOT IN ({_GENERIC})) AS ats FROM base
), prep AS (
  SELECT *, list_transform(list_sort(list_transform(list_distinct(ats), lambda w: lpad((100000000 - length(w))::VARCHAR, 9, '0') || w)), lambda x: substr(x, 10)) AS strong,
    list_filter(string_split(replace(name, ' ', ''), ''), lambda x: x <> '') AS name_chars, list_filter(string_split(replace(addr, ' ', ''), ''), lambda x: x <> '') AS addr_chars FROM tok
)"""


def grams_sql(chars: str, n: int) -> str:
    """The distinct n-grams of a list of characters; a shorter one is one gram."""
    zipped = f"list_zip({', '.join([chars, *(f'{chars}[{i}:]' for i in range(2, n + 1))])}, true)"
    return f"CASE WHEN len({chars}) >= {n} THEN list_distinct(list_transform({zipped}, lambda x: {' || '.join(f'x[{i}]' for i in range(1, n + 1))})) WHEN len({chars}) > 0 THEN [array_to_string({chars}, '')] ELSE [] END"


GRAM_DF = f"""grams AS (SELECT entity_id, src, country, unnest({grams_sql("name_chars", 3)}) AS gram FROM prep),
gram_df AS (SELECT country, gram, count(*) AS freq FROM grams WHERE src = 0 GROUP BY ALL),
rare_grams AS (
  SELECT entity_id, country, gram, freq FROM (
    SELECT g.*, d.freq, row_number() OVER (PARTITION BY entity_id ORDER BY freq, gram) AS place, count(*) FILTER (freq <= 500) OVER (PARTITION BY entity_id) AS n_rare
    FROM grams g JOIN gram_df d USING (country, gram) WHERE g.src = 0 AND d.freq <= 5000)
  WHERE place <= 8 AND (freq <= 500 OR n_rare < 5)
)"""
TOKEN_DF = """atoks AS (SELECT entity_id, src, country, unnest(list_distinct(ats)) AS token FROM prep),
token_df AS (SELECT country, token, count(*) AS freq FROM atoks WHERE src = 0 GROUP BY ALL),
rare_tokens AS (
  SELECT entity_id, country, token, freq FROM (
    SELECT a.*, d.freq, row_number() OVER (PARTITION BY entity_id ORDER BY freq, length(token) DESC, token) AS place
    FROM atoks a JOIN token_df d USING (country, token) WHERE a.src = 0 AND d.freq <= 1000)
  WHERE place <= 3
)"""
_CROSS = "flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '|' || y)))"
_PAIRS = "flatten(list_transform(strong[1:5], lambda x, i: list_transform(strong[i + 1:5], lambda y: least(x, y) || '|' || greatest(x, y))))"
PAYLOADS = {
    "nx": "CASE WHEN len(nt) > 0 THEN [name] ELSE [] END",
    "ns": "CASE WHEN len(nt) > 0 THEN [array_to_string(list_sort(list_distinct(nt)), ' ')] ELSE [] END",
    "nc": "CASE WHEN length(array_to_string(nt, '')) >= 6 THEN [array_to_string(nt, '')] ELSE [] END",
    "ua": "CASE WHEN length(nt[1]) >= 2 THEN [nt[1] || '|' || nt[-1]] ELSE [] END",
    "ap": _PAIRS,
    "ar": "strong[1:3]",
    "an": _CROSS.format(a="nums[1:3]", b="strong[1:3]"),
    "pc": "list_filter(aw, lambda w: regexp_full_match(w, '\\p{Nd}{4,6}'))",
    "ag": f"CASE WHEN length(replace(addr, ' ', '')) >= 8 THEN list_sort({grams_sql('addr_chars', 4)})[1:4] ELSE [] END",
    "ah": _CROSS.format(a="nums[1:2]", b="strong[1:2]"),
}


def keys_sql(*signals: str) -> str:
    """CTE k: entity_id, src, sig, key."""
    parts = []
    for sig in signals:
        if sig == "ng":
            parts += ["SELECT entity_id, src, 'ng' AS sig, country || '|' || gram AS key FROM grams WHERE src <> 0", "SELECT entity_id, 0 AS src, 'ng', country || '|' || gram FROM rare_grams"]
        elif sig == "ar":
            parts += [f"SELECT entity_id, src, 'ar' AS sig, country || '|' || unnest({PAYLOADS['ar']}) AS key FROM prep WHERE src <> 0", "SELECT entity_id, 0 AS src, 'ar', country || '|' || token FROM rare_tokens"]
        else:
            parts.append(f"SELECT entity_id, src, '{sig}' AS sig, country || '|' || unnest({PAYLOADS[sig]}) AS key FROM prep")
    return f"k AS ({' UNION '.join(parts)}),\n" + joined_sql([s for s in LOWER.signals if s in signals], keys.CAPS_4)


def joined_sql(signals: list[str], caps: dict[str, int]) -> str:
    """CTE pairs: s1_id, target_id, mask, n_signals of the rows of k, within the caps; bits are in the signals' order."""
    cap = " ".join(f"WHEN '{s}' THEN {c}" for s, c in caps.items())
    bit = " ".join(f"WHEN '{s}' THEN {1 << i}" for i, s in enumerate(signals))
    return f"""s AS (SELECT entity_id, sig, key FROM k WHERE src = 0),
w AS (SELECT entity_id, sig, key FROM k WHERE src <> 0 AND (sig, key) IN (SELECT (sig, key) FROM s)),
live AS (SELECT sig, key FROM w GROUP BY ALL HAVING count(*) <= CASE sig {cap} END),
pairs AS (
  SELECT s.entity_id AS s1_id, w.entity_id AS target_id, bit_or(CASE sig {bit} END)::INT AS mask, bit_count(bit_or(CASE sig {bit} END)::INT)::INT AS n_signals
  FROM s JOIN w USING (sig, key) JOIN live USING (sig, key) GROUP BY ALL
)"""


def pairs_sql(records: str, *signals: str) -> str:
    parts = [records, NORM, *([GRAM_DF] if "ng" in signals else []), *([TOKEN_DF] if "ar" in signals else []), keys_sql(*signals)]
    return "WITH " + ",\n".join(parts)


def block_with(spark: SparkSession, sf_dir: str, *signals: str, orders: bool = False) -> DataFrame:
    if orders:
        rows = proxy.orders_records(spark, sf_dir)
        s1, targets = rows.where("src = 0"), rows.where("src <> 0")
    else:
        s1, targets = proxy.sides(spark, sf_dir)
    return blocking.block(s1, targets, dataclasses.replace(LOWER, signals=tuple(s for s in LOWER.signals if s in signals)))


ALL = LOWER.signals
SOME = ("nx", "ns", "ua", "ap")

# --- blocking ----------------------------------------------------------------------------------


@query(pairs_sql(REC, "nx") + f", {TRUTH} SELECT p.s1_id, p.target_id, p.n_signals, t.s1_id IS NOT NULL AS is_match FROM pairs p LEFT JOIN truth t USING (s1_id, target_id)")
def block_exact_name(spark, sf_dir):
    """N1, N7, nx, A1, A2, J1: pairs with one normalised name and country, and whether they are true."""
    hits = proxy.truth(spark, sf_dir).withColumn("is_match", F.lit(True))
    return block_with(spark, sf_dir, "nx").select(*PAIRS).join(hits, ["s1_id", "target_id"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))


@query(pairs_sql(REC, "ns") + " SELECT s1_id, target_id, n_signals FROM pairs")
def block_sorted_tokens(spark, sf_dir):
    return block_with(spark, sf_dir, "ns").select(*PAIRS)


@query(pairs_sql(REC, "nc") + " SELECT s1_id, target_id, n_signals FROM pairs")
def block_compact_name(spark, sf_dir):
    return block_with(spark, sf_dir, "nc").select(*PAIRS)


@query(pairs_sql(REC, "ua") + " SELECT s1_id, target_id, n_signals FROM pairs")
def block_first_last(spark, sf_dir):
    return block_with(spark, sf_dir, "ua").select(*PAIRS)


@query(pairs_sql(REC, "ap") + " SELECT s1_id, target_id, n_signals FROM pairs")
def block_address_pairs(spark, sf_dir):
    return block_with(spark, sf_dir, "ap").select(*PAIRS)


@query(pairs_sql(ORDERS, "an", "pc", "ah") + " SELECT s1_id, target_id, n_signals FROM pairs")
def block_number_token(spark, sf_dir):
    """X1, X2, X20, an, pc, ah over records with numbers."""
    return block_with(spark, sf_dir, "an", "pc", "ah", orders=True).select(*PAIRS)


@query(pairs_sql(REC, "ag") + " SELECT s1_id, target_id, n_signals FROM pairs")
def block_address_grams(spark, sf_dir):
    return block_with(spark, sf_dir, "ag").select(*PAIRS)


@query(pairs_sql(REC, *ALL) + " SELECT s1_id, target_id, mask, n_signals FROM pairs")
def capped_multi_signal_candidates(spark, sf_dir):
    """The whole generator but for the signals that need Unicode functions."""
    return block_with(spark, sf_dir, *ALL)


@query()
def candidates_v4(spark, sf_dir):
    return blocking.block(*proxy.sides(spark, sf_dir), keys.V4).select(*PAIRS)


@query()
def candidates_v3(spark, sf_dir):
    return blocking.block(*proxy.sides(spark, sf_dir), keys.V3).select(*PAIRS)


@query()
def candidates_v1(spark, sf_dir):
    return blocking.block(*proxy.sides(spark, sf_dir), keys.V1).select(*PAIRS)


def _ascii_words_sql(text: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(strip_accents(coalesce({text}, '')), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]+')"


_TWO = "flatten(list_transform({a}, lambda x, i: list_transform({a}[i + 1:], lambda y: x || '|' || y)))"
_PAYLOADS_MULTI = {
    "nx": "CASE WHEN len(names) > 0 THEN [array_to_string(names, ' ')] ELSE [] END",
    "ns": "CASE WHEN len(names) > 0 THEN [array_to_string(list_sort(list_distinct(names)), ' ')] ELSE [] END",
    "nc": "CASE WHEN length(array_to_string(names, '')) >= 6 THEN [array_to_string(names, '')] ELSE [] END",
    "np": _TWO.format(a="nv"),
    "ap": _TWO.format(a="av"),
    "an": _CROSS.format(a="dv", b="av"),
    "xn": _CROSS.format(a="nv", b="dv"),
}
_KEYS_MULTI = " UNION ".join(f"SELECT entity_id, src, '{sig}' AS sig, country || '|' || unnest({payload}) AS key FROM parts" for sig, payload in _PAYLOADS_MULTI.items())
_MULTI = f"""words AS (
  SELECT entity_id, src, trim(lower(coalesce(country, ''))) AS country, {_ascii_words_sql("business_address")} AS addrs,
    list_filter({_ascii_words_sql(f"regexp_replace(business_name, '{text.TLD_CASED}', '', 'g')")}, lambda w: w NOT IN ({_SUFFIXES})) AS names FROM rec
), known AS (
  SELECT word FROM (SELECT DISTINCT entity_id, unnest(list_concat(names, addrs)) AS word FROM words WHERE src = 0) GROUP BY 1 HAVING count(*) <= {keys.VOCABULARY_MOST}
), each AS (
  SELECT entity_id, 'nv' AS part, unnest(list_filter(names, lambda w: length(w) >= 3)) AS word FROM words
  UNION SELECT entity_id, 'av', unnest(list_filter(addrs, lambda w: regexp_full_match(w, '[a-z]{{4,}}'))) FROM words
  UNION SELECT entity_id, 'dv', unnest(list_filter(addrs, lambda w: length(w) >= 2 AND regexp_matches(w, '[0-9]'))) FROM words
), held AS (
  SELECT entity_id, part, list(word ORDER BY word) AS ws FROM each SEMI JOIN known USING (word) GROUP BY ALL
), parts AS (
  SELECT words.*, coalesce(n.ws, [])[1:8] AS nv, coalesce(a.ws, [])[1:8] AS av, coalesce(d.ws, [])[1:4] AS dv FROM words
  LEFT JOIN held n ON n.entity_id = words.entity_id AND n.part = 'nv' LEFT JOIN held a ON a.entity_id = words.entity_id AND a.part = 'av'
  LEFT JOIN held d ON d.entity_id = words.entity_id AND d.part = 'dv'
), k AS ({_KEYS_MULTI}), {joined_sql([*keys.SIGNALS_MULTI], keys.CAPS_MULTI)}"""


@query(f"WITH {REC}, {_MULTI} SELECT s1_id, target_id, n_signals FROM pairs")
def candidates_multi(spark, sf_dir):
    """Names, and combinations of the words and numbers that the primary records' vocabulary has."""
    return blocking.block(*proxy.sides(spark, sf_dir), keys.MULTI).select(*PAIRS)


_WORDS_10 = ", ".join(f"'{w}'" for w in text.LEGAL_WORDS)
_PHRASES_10 = "|".join(x.replace(" ", "  ") for x in text.LEGAL_PHRASES)
_CHAR = f"""ch AS (SELECT entity_id, src, trim(lower(coalesce(country, ''))) AS country, {words_sql("business_address")} AS addr,
  array_to_string(list_filter(string_split(regexp_replace(' ' || replace({words_sql("business_name")}, ' ', '  ') || ' ', ' ({_PHRASES_10}) ', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({_WORDS_10})), ' ') AS name FROM rec),
cc AS (SELECT *, CASE WHEN name <> '' THEN list_filter(string_split(' ' || name || ' ', ''), lambda x: x <> '') ELSE [] END AS chars FROM ch),
k AS (SELECT DISTINCT entity_id, src, sig, country || '|' || payload AS key FROM (
  SELECT entity_id, src, country, 'exact_name' AS sig, name AS payload FROM cc WHERE name <> '' UNION ALL SELECT entity_id, src, country, 'char_name', unnest({grams_sql("chars", 3)}) FROM cc
  UNION ALL SELECT entity_id, src, country, 'addr_token', unnest(list_filter({split_sql("addr")}, lambda w: regexp_matches(w, '\\p{{Nd}}') OR length(w) >= 3)) FROM cc
  UNION ALL SELECT entity_id, src, country, 'addr_number', unnest(regexp_extract_all(addr, '\\p{{Nd}}+[a-zA-Z]?')) FROM cc)),
s AS (SELECT entity_id, sig, key FROM k WHERE src = 0), w AS (SELECT entity_id, sig, key FROM k WHERE src <> 0 AND (sig, key) IN (SELECT (sig, key) FROM s)),
live AS (SELECT entity_id, sig, key FROM (SELECT *, row_number() OVER (PARTITION BY sig, key ORDER BY entity_id) AS place, count(*) OVER (PARTITION BY sig, key) AS n FROM w) WHERE CASE sig WHEN 'exact_name' THEN place ELSE n END <= 300),
v AS (SELECT sig, s.entity_id AS s1_id, live.entity_id AS target_id, count(*) AS votes FROM s JOIN live USING (sig, key) GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sig, s1_id ORDER BY votes DESC, target_id) AS place FROM v) WHERE sig NOT IN ('char_name', 'addr_token') OR place <= 300)"""


@query(f"WITH {REC}, {_CHAR} SELECT s1_id, target_id, count(DISTINCT sig)::INT AS n_signals FROM kept GROUP BY ALL")
def candidates_char(spark, sf_dir):
    """Names, grams, address words and numbers."""
    return blocking.char_candidates(*proxy.sides(spark, sf_dir), how="lower").select(*PAIRS)


def _prepared(spark, sf_dir):
    s1, targets = proxy.sides(spark, sf_dir)
    return keys.prepare(s1, "lower"), keys.prepare(targets, "lower")


@query(f"WITH {REC}, {NORM}, {GRAM_DF} SELECT entity_id, country, gram, freq FROM rare_grams")
def rare_ngram_keys(spark, sf_dir):
    """X9, K1, K3, W1."""
    s1, _ = _prepared(spark, sf_dir)
    return keys.rare_grams(s1, keys.gram_frequencies(s1))


@query(f"WITH {REC}, {NORM}, {TOKEN_DF} SELECT entity_id, country, token, freq FROM rare_tokens")
def rare_token_keys(spark, sf_dir):
    """X4, K2, K4, W1."""
    s1, _ = _prepared(spark, sf_dir)
    return keys.rare_tokens(s1, keys.token_frequencies(s1))


_PREFIX = f"""pk AS (SELECT entity_id, src, country, {split_sql(words_sql("replace(business_name, '&', ' and ')"))} AS w FROM rec),
pkeys AS (SELECT entity_id, src, country || '|' || unnest(list_distinct(
  list_filter([CASE WHEN length(w[1]) >= 3 THEN substr(w[1], 1, 3) END, CASE WHEN length(w[1]) >= 4 THEN substr(w[1], 1, 4) END, CASE WHEN length(w[1]) >= 5 THEN substr(w[1], 1, 5) END,
    CASE WHEN length(w[1] || w[2]) >= 5 THEN substr(w[1] || w[2], 1, 5) END], lambda x: x IS NOT NULL)
  || list_transform(list_filter(w, lambda x: length(x) >= 4), lambda x: substr(x, 1, 4)) || list_transform(list_filter(w, lambda x: length(x) >= 5), lambda x: substr(x, 1, 5)))) AS key FROM pk)"""


@query(f"WITH {REC}, {_PREFIX} SELECT a.entity_id AS s1_id, b.entity_id AS target_id, count(*) AS votes FROM pkeys a JOIN pkeys b USING (key) WHERE a.src = 0 AND b.src <> 0 GROUP BY ALL")
def block_prefix_keys(spark, sf_dir):
    """Every pair that shares a prefix key."""
    return blocking.prefix_votes(*proxy.sides(spark, sf_dir))


@query(f"""WITH {REC}, {_PREFIX}, {TRUTH}, v AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS target_id FROM pkeys a JOIN pkeys b USING (key) WHERE a.src = 0 AND b.src <> 0),
h AS (SELECT (SELECT count(*) FROM truth) AS truths, (SELECT count(*) FROM truth JOIN v USING (s1_id, target_id)) AS recovered)
SELECT k, recovered, truths, round(recovered / truths, 9) AS recall FROM h, (SELECT unnest([10, 25, 50, 100, 250, 500]) AS k)""")
def unranked_recall(spark, sf_dir):
    """Recall of the unranked prefix blocks, the same for every k."""
    return evaluation.unranked_recall(proxy.truth(spark, sf_dir), blocking.shared_in_truth(proxy.truth(spark, sf_dir), *(blocking.prefix_block_keys(r) for r in proxy.sides(spark, sf_dir))))


@query(f"""WITH {REC}, {_PREFIX}, b AS (SELECT key, count(*) AS n FROM pkeys WHERE src <> 0 GROUP BY 1)
SELECT count(*) AS count, round(avg(n), 9) AS mean, median(n) AS median, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95,
  quantile_cont(n, 0.99) AS p99, quantile_cont(n, 0.999) AS p99_9, max(n) AS max FROM b""")
def block_size_stats(spark, sf_dir):
    """A26."""
    _, targets = proxy.sides(spark, sf_dir)
    return evaluation.block_sizes(blocking.prefix_block_keys(targets))


@query(f"""WITH {REC}, e AS (SELECT entity_id, src, coalesce(country, '') AS country, {words_sql("replace(business_address, '&', ' and ')")} AS a FROM rec)
SELECT x.entity_id AS s1_id, y.entity_id AS target_id FROM e x JOIN e y USING (country, a) WHERE x.src = 0 AND y.src <> 0 AND a <> ''""")
def block_exact_address(spark, sf_dir):
    """N14, J7."""
    return blocking.exact_address(*proxy.sides(spark, sf_dir))


@query(f"""WITH {REC}, e AS (SELECT entity_id, src, {words_sql("replace(business_name, '&', ' and ')")} AS a FROM rec)
SELECT x.entity_id AS s1_id, y.entity_id AS target_id FROM e x JOIN e y USING (a) WHERE x.src = 0 AND y.src <> 0 AND a <> ''""")
def block_name_any_country(spark, sf_dir):
    """Every pair of one name, names of many targets dealt over parts."""
    s1, targets = (r.select("entity_id", F.lit("na").alias("sig"), text.normalize_text(F.col("business_name")).alias("key")) for r in proxy.sides(spark, sf_dir))
    left, right = blocking.dealt(s1.where("key <> ''"), targets.where("key <> ''"))
    return left.withColumnRenamed("entity_id", "s1_id").join(right.withColumnRenamed("entity_id", "target_id"), ["sig", "key"]).select("s1_id", "target_id")


#: Letters without their marks, ASCII only, words of a-z and 0-9: N2 for the letters of Latin scripts.
_PLAIN = "trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_TRAILING = f"regexp_replace({_PLAIN.format(c='business_name')}, '( ({'|'.join(text.TRAILING_PHRASES)}))+$', '')"


@query(f"""WITH {REC}, e AS (SELECT entity_id, src, coalesce(country, '') AS country, {_TRAILING} AS a FROM rec)
SELECT x.entity_id AS s1_id, y.entity_id AS target_id FROM e x JOIN e y USING (country, a) WHERE x.src = 0 AND y.src <> 0 AND a <> ''""")
def block_exact_normalized(spark, sf_dir):
    """S2 and S3 joined apart, then united."""
    s1, targets = proxy.sides(spark, sf_dir)
    return blocking.exact_normalized(s1, targets.where("src = 1")).union(blocking.exact_normalized(s1, targets.where("src = 2"))).distinct()


@query()
def block_transliterated(spark, sf_dir):
    """N3, N18, J9."""
    return blocking.transliterated_matches(*proxy.sides(spark, sf_dir))


_STOP = ", ".join(f"'{w}'" for w in tokens.ADDRESS_STOP)
_SIGN_SUFFIXES = ", ".join(f"'{w}'" for w in text.LEGAL_SUFFIXES_SIGNATURE)
_TWO = "least(substr({w}[1], 1, {n}), substr({w}[2], 1, {n})) || '|' || greatest(substr({w}[1], 1, {n}), substr({w}[2], 1, {n}))"
_SIGNATURES = f"""sn AS (SELECT entity_id, src, trim(lower(coalesce(country, ''))) AS country, list_filter({split_sql(words_sql("business_name"))}, lambda w: w NOT IN ({_SIGN_SUFFIXES})) AS nt, {words_sql("business_address")} AS addr FROM rec),
sp AS (SELECT *, {split_sql(_PLAIN.format(c="array_to_string(nt, ' ')"))} AS pt, regexp_extract_all(addr, '\\p{{Nd}}+[a-zA-Z]?') AS nums,
  list_filter({split_sql("addr")}, lambda w: regexp_matches(w, '\\p{{Nd}}') OR (length(w) >= 4 AND w NOT IN ({_STOP}))) AS wt FROM sn),
st AS (SELECT *, list_sort(list_transform(list_filter(nt, lambda w: length(w) >= 3), lambda w: substr(w, 1, 4)))[1:4] AS parts FROM sp),
sk AS (SELECT entity_id, src, country, unnest(list_distinct(list_filter(
  [CASE WHEN length(nt[1]) >= 3 THEN 'FIRST:' || substr(nt[1], 1, 5) END, CASE WHEN length(nt[-1]) >= 3 THEN 'LAST:' || substr(nt[-1], 1, 5) END, CASE WHEN len(nt) > 1 THEN 'PAIR:' || {_TWO.format(w="nt", n=4)} END,
   CASE WHEN len(parts) > 0 THEN 'TOK:' || array_to_string(parts, '|') END, CASE WHEN len(pt) > 0 THEN 'ASCII_FIRST:' || substr(pt[1], 1, 5) END, CASE WHEN len(pt) > 1 THEN 'ASCII_PAIR:' || {_TWO.format(w="pt", n=4)} END,
   CASE WHEN len(wt) > 0 THEN 'ADDR_FIRST:' || substr(wt[1], 1, 6) END, CASE WHEN len(wt) > 1 THEN 'ADDR_PAIR:' || {_TWO.format(w="wt", n=5)} END]
  || list_transform(nums, lambda x: 'NUM:' || x) || list_transform(wt, lambda w: 'ADDR:' || substr(w, 1, 8)) || list_transform(list_filter(nums, lambda x: length(x) >= 5), lambda x: 'POST:' || x), lambda x: x IS NOT NULL))) AS payload FROM st),
k AS (SELECT entity_id, src, country || '|' || payload AS key FROM sk)"""


@query(f"""WITH {REC}, {_SIGNATURES}, s AS (SELECT entity_id, key FROM k WHERE src = 0), w AS (SELECT entity_id, key FROM k WHERE src <> 0 AND key IN (SELECT key FROM s)),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY entity_id) AS place FROM w) WHERE place <= 300),
v AS (SELECT s.entity_id AS s1_id, cut.entity_id AS target_id, count(*) AS votes FROM s JOIN cut USING (key) GROUP BY ALL)
SELECT s1_id, target_id, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY votes DESC, target_id)::INT AS rank FROM v) WHERE rank <= 300""")
def signature_votes(spark, sf_dir):
    """Postings cut at 300, the first 300 targets by shared signatures."""
    return blocking.signature_votes(*proxy.sides(spark, sf_dir), how="lower")


@query(pairs_sql(REC, "nx", "ns", "ua", "ap") + """, cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sig, key ORDER BY entity_id) AS place FROM w) WHERE place <= 20),
v AS (SELECT s.entity_id AS s1_id, cut.entity_id AS target_id, count(*) AS votes FROM s JOIN cut USING (sig, key) GROUP BY ALL)
SELECT s1_id, target_id, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY votes DESC, target_id)::INT AS rank FROM v) WHERE rank <= 10""")
def truncated_postings_votes(spark, sf_dir):
    """A4, A23, W2."""
    s1, targets = _prepared(spark, sf_dir)
    config = dataclasses.replace(LOWER, signals=SOME)
    own = materialize(keys.primary_keys(s1, config), "own-keys")
    found = blocking.votes(own, blocking.truncated(blocking.wanted(keys.target_keys(targets, config), own), 20))
    return ranking.top(found, 10, F.col("votes").desc(), F.col("target_id")).select("s1_id", "target_id", "votes", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {REC}, {NORM} SELECT DISTINCT unnest(list_filter(aw, lambda w: (regexp_matches(w, '\\p{{Nd}}') OR length(w) >= 4) AND w NOT IN ({', '.join(repr(w) for w in tokens.ADDRESS_GENERIC)})) || nums) AS word FROM base WHERE src = 0")
def address_vocabulary(spark, sf_dir):
    """X5, K5."""
    return keys.vocabulary(_prepared(spark, sf_dir)[0])


# --- ranked retrieval --------------------------------------------------------------------------

_TOKS = f"""tk AS (SELECT DISTINCT entity_id, src, unnest({split_sql("trim(regexp_replace(lower(coalesce(business_name, '') || ' ' || coalesce(business_address, '')), '[^a-z0-9]+', ' ', 'g'))")}) AS tok FROM ascii),
post AS (SELECT entity_id, tok FROM tk WHERE src <> 0 AND length(tok) >= 2), mine AS (SELECT entity_id, tok FROM tk WHERE src = 0 AND length(tok) >= 2),
df AS (SELECT tok, count(*) AS df FROM post GROUP BY 1)"""
_ASCII = "ascii AS (SELECT entity_id, src, regexp_replace(business_name, '[^\\x00-\\x7F]', '', 'g') AS business_name, regexp_replace(business_address, '[^\\x00-\\x7F]', '', 'g') AS business_address FROM rec)"


def _postings(spark, sf_dir):
    """Tokens of primary and secondary records, of their ASCII characters only (as in the SQL)."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "").alias(c)
    s1, targets = proxy.sides(spark, sf_dir)
    only = lambda r: ranking.record_tokens(r.select("entity_id", plain("business_name"), plain("business_address")))
    return only(s1), only(targets)


@query(f"WITH {REC}, {_ASCII}, {_TOKS} SELECT tok, df FROM df WHERE df <= 300")
def token_df_filter(spark, sf_dir):
    """N17, A6, K6."""
    return ranking.token_counts(_postings(spark, sf_dir)[1], 300)


@query(f"""WITH {REC}, {_ASCII}, {_TOKS}, r AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY entity_id ORDER BY df, tok) AS place FROM mine m JOIN df USING (tok) WHERE df <= 1000) WHERE place <= 5)
SELECT r.entity_id AS s1_id, p.entity_id AS target_id, count(*) AS votes FROM r JOIN post p USING (tok) GROUP BY ALL HAVING count(*) >= 2""")
def rare_token_votes(spark, sf_dir):
    """W1, A23 with the setting (5, 1000, 2)."""
    mine, post = _postings(spark, sf_dir)
    return ranking.token_votes(mine, post, *ranking.TOKEN_SETTINGS[2])


@query(f"""WITH {REC}, {_ASCII}, {_TOKS}, n AS (SELECT count(*) AS n FROM rec WHERE src <> 0),
v AS (SELECT m.entity_id AS s1_id, p.entity_id AS target_id, round(sum(ln(n / df)), 6) AS score FROM mine m JOIN df USING (tok) JOIN post p USING (tok), n WHERE df <= 100 GROUP BY ALL)
SELECT s1_id, target_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id DESC)::INT AS rank FROM v) WHERE rank <= 10""")
def idf_vote_topk(spark, sf_dir):
    """A24, W3."""
    mine, post = _postings(spark, sf_dir)
    n = proxy.sides(spark, sf_dir)[1].count()
    mine, post = materialize(mine, "tokens"), materialize(post, "tokens")
    found = ranking.idf_votes(mine, post, n, 100).withColumn("score", F.round("score", 6))
    return ranking.top(found, 10, F.col("score").desc(), F.col("target_id").desc()).select("s1_id", "target_id", "score", F.col("rank").cast("int").alias("rank"))


@query(pairs_sql(REC, *SOME) + """, d AS (SELECT sig, key, count(*) AS df FROM w GROUP BY ALL HAVING count(*) <= 100),
v AS (SELECT s.entity_id AS s1_id, w.entity_id AS target_id, count(DISTINCT sig)::INT AS n_signals, round(sum(1.0::DOUBLE / df), 6) AS score FROM s JOIN w USING (sig, key) JOIN d USING (sig, key) GROUP BY ALL)
SELECT s1_id, target_id, n_signals, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_signals DESC, score DESC, target_id)::INT AS rank FROM v) WHERE rank <= 20""")
def inverse_block_rank(spark, sf_dir):
    """A25, W4."""
    s1, targets = _prepared(spark, sf_dir)
    config = dataclasses.replace(LOWER, signals=SOME)
    own, posted = keys.primary_keys(s1, config), materialize(keys.target_keys(targets, config), "target-keys")
    found = ranking.inverse_block_votes(own, posted, SOME, 100).withColumn("score", F.round("score", 6))
    return ranking.top(found, 20, F.col("n_signals").desc(), F.col("score").desc(), F.col("target_id")).select("s1_id", "target_id", "n_signals", "score", F.col("rank").cast("int").alias("rank"))


@query()
def tfidf_topk(spark, sf_dir):
    """The hundred nearest targets by cosine of word n-grams."""
    s1, targets = proxy.sides(spark, sf_dir)
    return nearest.cosine_top(s1, targets, text.normalize_text(F.col("business_name")), 100).select("s1_id", "target_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("int").alias("rank"))


# --- evaluation --------------------------------------------------------------------------------


def _some(spark, sf_dir):
    return block_with(spark, sf_dir, *SOME)


def _some_stored(spark, sf_dir):
    """The pairs, written: for queries that read them more than once."""
    return materialize(_some(spark, sf_dir), "pairs")


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, r AS (SELECT (SELECT count(*) FROM truth) AS true_pairs, (SELECT count(*) FROM (SELECT DISTINCT * FROM truth)) AS indexed_pairs, (SELECT count(*) FROM truth JOIN pairs USING (s1_id, target_id)) AS recovered)
SELECT *, round(recovered / true_pairs, 9) AS full_recall, round(recovered / indexed_pairs, 9) AS indexed_recall FROM r""")
def recall_report(spark, sf_dir):
    """J10, J12, A16, R1, R3, R4."""
    s1, targets = proxy.sides(spark, sf_dir)
    return evaluation.recall(proxy.truth(spark, sf_dir), _some(spark, sf_dir), s1, targets)


_LISTS = "lists AS (SELECT r.entity_id AS source1_entity_id, coalesce(string_agg(t.target_id, ', ,' ORDER BY t.target_id), '') AS matched_entity_ids FROM rec r LEFT JOIN truth t ON r.entity_id = t.s1_id WHERE r.src = 0 GROUP BY 1)"


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, {_LISTS}, r AS (SELECT (SELECT sum(len(string_split(matched_entity_ids, ',')))::BIGINT FROM lists) AS listed, (SELECT count(*) FROM truth JOIN pairs USING (s1_id, target_id)) AS recovered)
SELECT *, round(recovered / listed, 9) AS recall FROM r""")
def recall_over_listed(spark, sf_dir):
    """X24, R2."""
    return evaluation.recall_over_listed(proxy.lists(spark, sf_dir), _some(spark, sf_dir))


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, t AS (SELECT t.s1_id, t.target_id, coalesce(mask, 0) AS mask FROM truth t LEFT JOIN pairs USING (s1_id, target_id)),
b AS (SELECT unnest(['nx', 'ns', 'ua', 'ap', 'union']) AS signal, unnest([1, 2, 4, 8, 15]) AS bits)
SELECT signal, count(*) FILTER (mask & bits <> 0) AS recovered, count(*) AS truths, round(count(*) FILTER (mask & bits <> 0) / count(*), 9) AS recall FROM t, b GROUP BY signal""")
def signal_recall(spark, sf_dir):
    """R6, U2."""
    return evaluation.signal_recall(proxy.truth(spark, sf_dir), _some(spark, sf_dir), SOME)


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, n AS (SELECT unnest([1, 2, 3]) AS least),
c AS (SELECT least, r.entity_id, count(p.s1_id) FILTER (p.n_signals >= least) AS c, r.entity_id IN (SELECT s1_id FROM truth) AS matched FROM n, rec r LEFT JOIN pairs p ON r.entity_id = p.s1_id WHERE r.src = 0 GROUP BY ALL),
m AS (SELECT least, sum(c)::BIGINT AS candidates, round(avg(c), 9) AS mean_candidates, round(avg(c) FILTER (NOT matched), 9) AS singleton_mean FROM c GROUP BY 1)
SELECT m.*, (SELECT count(*) FROM truth JOIN pairs USING (s1_id, target_id) WHERE n_signals >= m.least) AS recovered, (SELECT count(*) FROM truth) AS truths,
  round((SELECT count(*) FROM truth JOIN pairs USING (s1_id, target_id) WHERE n_signals >= m.least) / (SELECT count(*) FROM truth), 9) AS recall FROM m""")
def agreement_recall(spark, sf_dir):
    """R7, X27."""
    return evaluation.agreement_recall(proxy.truth(spark, sf_dir), _some_stored(spark, sf_dir), proxy.sides(spark, sf_dir)[0])


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, c AS (SELECT s1_id, count(*) AS n FROM pairs GROUP BY 1), t AS (SELECT (SELECT count(*) FROM truth) AS true_pairs, (SELECT count(*) FROM truth JOIN pairs USING (s1_id, target_id)) AS recovered)
SELECT true_pairs, recovered, round(recovered / true_pairs, 9) AS recall, count(*) AS s1_with_candidates, round(avg(n), 9) AS mean_candidates, median(n) AS median_candidates, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS most_candidates,
  (SELECT count(*) FROM truth WHERE target_id NOT IN (SELECT entity_id FROM rec WHERE src <> 0)) AS not_indexed, (SELECT count(*) FROM rec WHERE src = 0) AS s1_records, sum(n)::BIGINT AS candidate_rows, true_pairs - recovered AS missed,
  NULL::BOOLEAN AS as_many_as_expected, recovered <= true_pairs AS recovered_within_truth, recovered / true_pairs BETWEEN 0 AND 1 AS recall_within_bounds FROM c, t GROUP BY ALL""")
def corrected_report(spark, sf_dir):
    """The whole report, with its sanity checks."""
    return evaluation.corrected_report(proxy.truth(spark, sf_dir), _some_stored(spark, sf_dir), *proxy.sides(spark, sf_dir))


def _token_lists(spark, sf_dir):
    """entity_id, keys, scope of both sides: the tokens of ``_postings``, scoped by country apart from the tokens."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "").alias(c)
    only = lambda r: r.select("entity_id", plain("business_name"), plain("business_address"), F.xxhash64(F.coalesce("country", F.lit(""))).alias("scope"))
    return (ranking.token_lists(only(r)) for r in proxy.sides(spark, sf_dir))


@query(f"""WITH {REC}, {_ASCII}, {_TOKS}, {TRUTH}, caps AS (SELECT unnest([30, 100, 300, 1000, 3000]) AS cap), ks AS (SELECT unnest([10, 20, 50, 100]) AS k), n AS (SELECT count(*) AS n FROM rec WHERE src <> 0),
c AS (SELECT entity_id, coalesce(country, '') AS country FROM rec),
t AS (SELECT m.entity_id AS s1_id, p.entity_id AS target_id, df, ln(n / df) AS w FROM mine m JOIN df USING (tok) JOIN post p USING (tok) JOIN c a ON a.entity_id = m.entity_id JOIN c b ON b.entity_id = p.entity_id AND a.country = b.country, n WHERE df <= 3000),
v AS (SELECT cap, s1_id, target_id, round(sum(w), 6) AS score FROM t, caps WHERE df <= cap GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cap, s1_id ORDER BY score DESC, target_id DESC) AS rank FROM v),
e AS (SELECT x.cap, tr.s1_id, count(*) AS truths, count(r.rank) AS found, count(*) FILTER (r.rank <= 10) AS f10, count(*) FILTER (r.rank <= 20) AS f20, count(*) FILTER (r.rank <= 50) AS f50, count(*) FILTER (r.rank <= 100) AS f100
  FROM (SELECT DISTINCT * FROM truth) tr CROSS JOIN caps x LEFT JOIN r ON r.cap = x.cap AND r.s1_id = tr.s1_id AND r.target_id = tr.target_id GROUP BY ALL),
g AS (SELECT cap, sum(truths) AS truths, sum(found) AS found, count(*) AS records, count(*) FILTER (f50 = truths) AS whole, unnest([10, 20, 50, 100]) AS k, unnest([sum(f10), sum(f20), sum(f50), sum(f100)])::BIGINT AS recovered FROM e GROUP BY cap)
SELECT g.cap, k, round(found / truths, 9) AS ceiling, round(whole / records, 9) AS all_found_ratio, round((SELECT count(*) FROM v WHERE v.cap = g.cap) / (SELECT count(*) FROM rec WHERE src = 0), 9) AS mean_candidates, recovered, round(recovered / truths, 9) AS recall FROM g""")
def vote_cap_sweep(spark, sf_dir):
    """Recall at k under every cap on a token's records, within a country."""
    s1, targets = proxy.sides(spark, sf_dir)
    truth = proxy.truth(spark, sf_dir)
    met = materialize(ranking.capped_idf_ranks(*_token_lists(spark, sf_dir), truth, targets.count()), "ranks")
    return evaluation.rank_sweep(truth, met, s1, ranking.VOTE_KS)


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, caps AS (SELECT unnest([20, 100, 300]) AS cap), d AS (SELECT sig, key, count(*) AS df FROM w GROUP BY ALL),
x AS (SELECT DISTINCT cap, s.entity_id AS s1_id, w.entity_id AS target_id, sig FROM s JOIN w USING (sig, key) JOIN d USING (sig, key), caps WHERE df <= cap),
y AS (SELECT * FROM x UNION SELECT cap, s1_id, target_id, 'union' FROM x)
SELECT cap, sig AS signal, count(t.s1_id) AS recovered, round(count(t.s1_id) / (SELECT count(*) FROM truth), 9) AS recall, round(count(*) / (SELECT count(*) FROM rec WHERE src = 0), 9) AS mean_candidates FROM y LEFT JOIN truth t USING (s1_id, target_id) GROUP BY 1, 2""")
def signal_cap_sweep(spark, sf_dir):
    """Recall and candidates of each signal, and of all, under every cap."""
    s1, targets = _prepared(spark, sf_dir)
    config = dataclasses.replace(LOWER, signals=SOME)
    own, posted = keys.primary_keys(s1, config), materialize(keys.target_keys(targets, config), "target-keys")
    pairs = materialize(ranking.capped_signal_pairs(own, posted), "capped-pairs")
    return evaluation.signal_sweep(proxy.truth(spark, sf_dir), pairs, proxy.sides(spark, sf_dir)[0])


@query(f"""WITH {REC}, {_ASCII}, {_TOKS}, {TRUTH}, settings AS (SELECT unnest([3, 5, 5, 8, 8, 8]) AS k, unnest([300, 1000, 1000, 3000, 3000, 3000]) AS cap, unnest([1, 1, 2, 1, 2, 3]) AS shared),
r AS (SELECT * FROM (SELECT m.*, k, cap, shared, row_number() OVER (PARTITION BY k, cap, shared, m.entity_id ORDER BY df, tok) AS place FROM mine m JOIN df USING (tok), settings WHERE df <= cap) WHERE place <= k),
v AS (SELECT k, cap, shared, r.entity_id AS s1_id, p.entity_id AS target_id FROM r JOIN post p USING (tok) GROUP BY ALL HAVING count(*) >= any_value(shared)),
c AS (SELECT k, cap, shared, entity_id AS s1_id, (SELECT count(*) FROM v WHERE v.k = x.k AND v.cap = x.cap AND v.shared = x.shared AND v.s1_id = rec.entity_id) AS n, (SELECT count(*) FROM truth t WHERE t.s1_id = rec.entity_id) AS truths,
  (SELECT count(*) FROM truth t JOIN v USING (s1_id, target_id) WHERE v.k = x.k AND v.cap = x.cap AND v.shared = x.shared AND t.s1_id = rec.entity_id) AS found FROM settings x, rec WHERE src = 0)
SELECT k, cap, shared, round(sum(found) / sum(truths), 9) AS recall, round(count(*) FILTER (truths > 0 AND found = truths) / count(*) FILTER (truths > 0), 9) AS all_found_ratio, round(avg(n), 9) AS mean, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS max,
  round(avg(n) FILTER (truths = 0), 9) AS singleton_mean FROM c GROUP BY 1, 2, 3""")
def token_setting_sweep(spark, sf_dir):
    """The report of each of the six settings."""
    mine, post = (materialize(t, "tokens") for t in _postings(spark, sf_dir))
    s1, truth = proxy.sides(spark, sf_dir)[0], proxy.truth(spark, sf_dir)
    out = []
    for k, cap, shared in ranking.TOKEN_SETTINGS:  # a handful
        pairs = materialize(ranking.token_votes(mine, post, k, cap, shared), "votes")
        out.append(evaluation.setting_report(truth, pairs, s1).select(F.lit(k).alias("k"), F.lit(cap).alias("cap"), F.lit(shared).alias("shared"), "*"))
    return reduce(DataFrame.unionByName, out)


@query()
def translit_lift(spark, sf_dir):
    """R8 with the A/B generator: its keys with and without transliterated names."""
    plain, spelled = (blocking.block(*proxy.sides(spark, sf_dir), config) for config in (keys.AB_PLAIN, keys.AB_SPELLED))
    return evaluation.lift(proxy.truth(spark, sf_dir), plain, spelled)


_RANKED = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_signals DESC, target_id) AS rank FROM pairs)"""


@query(pairs_sql(REC, *SOME) + _RANKED + f""", {TRUTH}, ks AS (SELECT unnest([1, 2, 5, 10]) AS k),
e AS (SELECT k, t.s1_id, count(*) AS truths, count(*) FILTER (rank <= k) AS found FROM truth t LEFT JOIN ranked USING (s1_id, target_id), ks GROUP BY ALL)
SELECT k, sum(found)::BIGINT AS recovered, sum(truths)::BIGINT AS truths, count(*) FILTER (found = truths) AS all_found, count(*) AS records, round(sum(found) / sum(truths), 9) AS recall, round(count(*) FILTER (found = truths) / count(*), 9) AS all_found_ratio FROM e GROUP BY k""")
def recall_at_k(spark, sf_dir):
    """W6, R9, U5."""
    ranked = ranking.top(_some(spark, sf_dir), 10, F.col("n_signals").desc(), F.col("target_id"))
    return evaluation.recall_at(proxy.truth(spark, sf_dir), ranked, (1, 2, 5, 10))


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, e AS (SELECT t.s1_id, count(*) AS truths, count(p.s1_id) AS found FROM truth t LEFT JOIN pairs p USING (s1_id, target_id) GROUP BY 1)
SELECT count(*) AS with_match, round(avg(found / truths), 9) AS mean, median(found / truths) AS median, min(found / truths) AS least, count(*) FILTER (found > 0) AS some_found, count(*) FILTER (found = truths) AS all_found,
  round(count(*) FILTER (found = truths) / count(*), 9) AS all_found_ratio FROM e""")
def record_recall(spark, sf_dir):
    """A17, A18, R5."""
    return evaluation.record_recall(proxy.truth(spark, sf_dir), _some(spark, sf_dir))


@query(pairs_sql(REC, "pc") + f", {TRUTH} SELECT s1_id, target_id FROM truth ANTI JOIN pairs USING (s1_id, target_id)")
def missed_pairs(spark, sf_dir):
    """What long numbers alone don't find."""
    return evaluation.missed(proxy.truth(spark, sf_dir), block_with(spark, sf_dir, "pc"))


@query(f"WITH {REC}, {TRUTH} SELECT s1_id, target_id FROM truth WHERE target_id NOT IN (SELECT entity_id FROM rec WHERE src = 1)")
def not_indexed(spark, sf_dir):
    """With one of the two secondary sources only."""
    return evaluation.not_indexed(proxy.truth(spark, sf_dir), proxy.records(spark, sf_dir).where("src = 1"))


@query(pairs_sql(REC, *SOME) + """, c AS (SELECT r.entity_id, count(p.s1_id) AS n FROM rec r LEFT JOIN pairs p ON r.entity_id = p.s1_id WHERE src = 0 GROUP BY 1)
SELECT count(*) AS count, round(avg(n), 9) AS mean, median(n) AS median, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS max FROM c""")
def candidate_stats(spark, sf_dir):
    """A8 (with zeros), A9."""
    return evaluation.distribution(evaluation.candidate_counts(_some(spark, sf_dir), proxy.sides(spark, sf_dir)[0]))


@query(pairs_sql(REC, *SOME) + """, c AS (SELECT s1_id, count(*) AS n FROM pairs GROUP BY 1)
SELECT count(n) AS count, round(avg(n), 9) AS mean, round(stddev_samp(n), 9) AS std, min(n) AS min, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n) AS max FROM c""")
def candidate_summary(spark, sf_dir):
    """A8 (without zeros), A10."""
    return evaluation.described(evaluation.candidate_counts(_some(spark, sf_dir)), "n")


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, b AS (SELECT * FROM pairs WHERE mask & 3 <> 0),
r AS (SELECT (SELECT count(*) FROM truth) AS truths, (SELECT count(*) FROM b) AS pairs_before, (SELECT count(*) FROM pairs) AS pairs_after, (SELECT count(*) FROM pairs ANTI JOIN b USING (s1_id, target_id)) AS extra_pairs,
  (SELECT count(*) FROM truth JOIN b USING (s1_id, target_id)) AS recovered_before, (SELECT count(*) FROM truth JOIN pairs USING (s1_id, target_id)) AS recovered_after,
  (SELECT count(*) FROM (SELECT * FROM pairs ANTI JOIN b USING (s1_id, target_id)) p JOIN truth USING (s1_id, target_id)) AS extra_true_pairs)
SELECT *, round(recovered_after / truths - recovered_before / truths, 9) AS lift, round(pairs_after / pairs_before, 9) AS growth,
  CASE WHEN recovered_after / truths - recovered_before / truths >= 0.01 THEN 'KEEP' WHEN recovered_after / truths - recovered_before / truths >= 0.005 THEN 'POSSIBLY' ELSE 'DROP' END AS verdict FROM r""")
def ab_lift(spark, sf_dir):
    """Names alone against names and address pairs."""
    return evaluation.lift(proxy.truth(spark, sf_dir), block_with(spark, sf_dir, "nx", "ns"), _some(spark, sf_dir))


# --- features and diagnosis --------------------------------------------------------------------

_FEAT = f"""f AS (SELECT entity_id, trim(regexp_replace(lower(coalesce(business_name, '')), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(coalesce(business_address, '')), '[^a-z0-9]+', ' ', 'g')) AS a, lower(coalesce(country, '')) AS c FROM rec),
g AS (SELECT *, list_distinct({split_sql("n")}) AS nw, list_distinct({split_sql("a")}) AS w, list_distinct(regexp_extract_all(a, '[0-9]+')) AS d FROM f)"""
_JACC = "CASE WHEN len(list_distinct({a} || {b})) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b})) / len(list_distinct({a} || {b})) END"


@query(pairs_sql(REC, *SOME) + f""", {_FEAT} SELECT s1_id, target_id, n_signals, (x.n = y.n AND x.n <> '')::INT AS name_exact, {_JACC.format(a="x.nw", b="y.nw")} AS name_token_jaccard, abs(length(x.n) - length(y.n))::INT AS name_len_diff,
  (x.a = y.a AND x.a <> '')::INT AS address_exact, {_JACC.format(a="x.w", b="y.w")} AS address_token_jaccard, abs(length(x.a) - length(y.a))::INT AS address_len_diff, {_JACC.format(a="x.d", b="y.d")} AS number_overlap,
  len(list_intersect(x.d, y.d))::INT AS number_count_common, (x.c = y.c)::INT AS country_match, (x.n = '' OR y.n = '')::INT AS name_missing, (x.a = '' OR y.a = '')::INT AS address_missing
FROM pairs JOIN g x ON x.entity_id = s1_id JOIN g y ON y.entity_id = target_id""")
def pair_features_set(spark, sf_dir):
    """N15, X3, F5-F10, J13, J14."""
    return features.set_features(_some(spark, sf_dir).select(*PAIRS), *proxy.sides(spark, sf_dir), "lower")


@query()
def pair_features_fuzzy(spark, sf_dir):
    """The whole vector."""
    return features.features(_some(spark, sf_dir).select(*PAIRS), *proxy.sides(spark, sf_dir))


@query(f"WITH {REC}, {NORM.split('), tok AS')[0]}) SELECT entity_id, country, name, addr FROM base")
def normalized_records(spark, sf_dir):
    """N1, N6-N8, N19."""
    return keys.prepare(proxy.records(spark, sf_dir), "lower").select("entity_id", "country", "name", "addr")


@query()
def normalizer_variants(spark, sf_dir):
    """N2-N5, N9-N14, N16-N18, N20, N21 of every name."""
    name, address = F.col("business_name"), F.col("business_address")
    forms = {
        "ascii": text.ascii_normalize(name), "spelled": text.transliterate(name), "spelled_always": text.transliterate(name, "always"), "spelled_other": text.transliterate(name, "nothing"),
        "signature": text.normalize_name(name, suffixes=text.LEGAL_SUFFIXES_SIGNATURE), "phrases": text.name_without_phrases(name), "trailing": text.name_without_trailing(name), "by_list": text.name_by_suffix_list(name),
        "last_words": text.name_without_last_words(name), "lower_nfkc": text.normalize_text(name), "ascii_name": text.ascii_name(name), "suffixes": text.remove_suffixes(name),
        "words": F.array_join(text.token_list(name, address), " "), "non_latin": text.has_non_latin(name), "non_ascii": text.has_non_ascii(name, address),
    }
    return proxy.records(spark, sf_dir).select("entity_id", *[c.alias(k) for k, c in forms.items()])


def _near(spark, sf_dir):
    """Pairs that share an address pair or a first and last word, with both records."""
    return diagnosis.with_records(block_with(spark, sf_dir, "ua", "ap").select("s1_id", "target_id"), *proxy.sides(spark, sf_dir))


@query()
def miss_categories(spark, sf_dir):
    """F12, A19."""
    return evaluation.histogram(diagnosis.similarities(_near(spark, sf_dir)), "category")


@query()
def similarity_buckets(spark, sf_dir):
    """A20."""
    return diagnosis.similarity_buckets(diagnosis.similarities(_near(spark, sf_dir)))


@query()
def miss_classes(spark, sf_dir):
    """both classifications of each pair."""
    rows = diagnosis.with_needed_addresses(block_with(spark, sf_dir, "ua", "ap").select("s1_id", "target_id"), *proxy.sides(spark, sf_dir))
    return diagnosis.name_relation(diagnosis.closeness(rows)).select("s1_id", "target_id", "class", "relation")


@query()
def union_miss_groups(spark, sf_dir):
    """F15, A22."""
    return diagnosis.group_medians(diagnosis.union_miss_group(_near(spark, sf_dir)))


@query()
def recovery_flags(spark, sf_dir):
    """F16, A21."""
    return diagnosis.recovery_flags(_near(spark, sf_dir))


@query()
def match_rates(spark, sf_dir):
    """F4, F17 on the true pairs."""
    return diagnosis.match_rates(diagnosis.with_records(proxy.truth(spark, sf_dir), *proxy.sides(spark, sf_dir)))


@query()
def sibling_reachable(spark, sf_dir):
    """J19 for the true pairs that long numbers alone don't find."""
    _, targets = proxy.sides(spark, sf_dir)
    truth = proxy.truth(spark, sf_dir)
    return diagnosis.sibling_reachable(evaluation.missed(truth, block_with(spark, sf_dir, "pc")), truth, targets)


# --- training ----------------------------------------------------------------------------------

_LABELLED = pairs_sql(REC, *SOME) + f", {TRUTH}, l AS (SELECT p.s1_id, p.target_id, p.n_signals, (t.s1_id IS NOT NULL)::INT AS label FROM pairs p LEFT JOIN truth t USING (s1_id, target_id))"


@query(_LABELLED + """, pos AS (SELECT * FROM l WHERE label = 1), neg AS (SELECT * FROM l WHERE label = 0 QUALIFY row_number() OVER (ORDER BY md5(s1_id || ':' || target_id || ':42')) <= 4 * (SELECT count(*) FROM pos))
SELECT * FROM pos UNION ALL SELECT * FROM neg""")
def training_pairs(spark, sf_dir):
    """M1, M5, J10 (without the split, whose CRC-32 DuckDB lacks)."""
    return training.training_pairs(_some(spark, sf_dir).select(*PAIRS), proxy.truth(spark, sf_dir)).drop("split")


@query(pairs_sql(REC, *SOME) + f""", {TRUTH}, bad AS (SELECT s1_id, target_id, n_signals FROM pairs ANTI JOIN truth USING (s1_id, target_id))
SELECT * FROM (SELECT DISTINCT s1_id, target_id, 0 AS n_signals, 1 AS label FROM truth QUALIFY row_number() OVER (ORDER BY md5(s1_id || ':' || target_id || ':42')) <= 100000)
UNION ALL SELECT s1_id, target_id, n_signals, 0 FROM bad QUALIFY row_number() OVER (ORDER BY md5(s1_id || ':' || target_id || ':42')) <= 300000""")
def early_training_sample(spark, sf_dir):
    """M6 (without the split, whose CRC-32 DuckDB lacks)."""
    return training.early_sample(_some(spark, sf_dir).select(*PAIRS), proxy.truth(spark, sf_dir)).drop("split")


@query()
def group_split(spark, sf_dir):
    """Rows of each split, and the leaked ids, of which there must be none."""
    rows = materialize(training.training_pairs(_some(spark, sf_dir).select(*PAIRS), proxy.truth(spark, sf_dir)), "training-pairs")
    return rows.groupBy("split", "label").agg(F.count("*").alias("n")).crossJoin(training.leaked(rows).agg(F.count("*").alias("leaked")))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':42')) <= CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 50 END")
def stratified_sample(spark, sf_dir):
    """M4."""
    limits = spark.createDataFrame([("F", 100), ("O", 50)], "o_orderstatus string, most long")
    return sampling.sample_by(proxy.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"], limits, ["o_orderkey"])


@query("WITH t AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () // 100 AS step FROM (SELECT o_orderkey, o_custkey FROM orders)) SELECT o_orderkey, o_custkey FROM t WHERE pos % step = 0 AND pos < step * 100")
def evenly_spaced(spark, sf_dir):
    """W9."""
    return sampling.every_nth(proxy.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


_SCORED = "WITH sc AS (SELECT toxic AS label, ((doc_id * 37) % 1000) / 1000 AS probability FROM labels), th AS (SELECT round(0.10 + 0.01 * i, 2)::DOUBLE AS threshold FROM range(86) r(i))"
_SWEEP = """, sw AS (SELECT threshold, count(*) FILTER (label = 1 AND probability >= threshold) AS tp, count(*) FILTER (label = 0 AND probability >= threshold) AS fp, count(*) FILTER (label = 1 AND probability < threshold) AS fn,
  count(*) FILTER (label = 0 AND probability < threshold) AS tn FROM sc, th GROUP BY 1),
res AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 0), 9) AS f FROM sw)"""


def _pseudo(spark, sf_dir):
    return proxy.table(spark, sf_dir, "labels").select(F.col("toxic").alias("label"), ((F.col("doc_id") * 37) % 1000 / 1000).alias("probability"))


@query(_SCORED + _SWEEP + " SELECT threshold, tp, fp, fn, tn, precision, recall, f FROM res")
def threshold_sweep(spark, sf_dir):
    """A27, R11, W7, on a probability made of the id."""
    return evaluation.threshold_sweep(_pseudo(spark, sf_dir))


@query(_SCORED + _SWEEP + " SELECT threshold, tp, fp, fn, tn, precision, recall, f FROM res ORDER BY f DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    """W8."""
    return evaluation.best_threshold(evaluation.threshold_sweep(_pseudo(spark, sf_dir)))


@query("SELECT count(*) FILTER (toxic = 0) AS negatives, count(*) FILTER (toxic = 1) AS positives, round(count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1), 9) AS ratio FROM labels")
def class_ratio(spark, sf_dir):
    """A28."""
    return evaluation.class_ratio(_pseudo(spark, sf_dir))


def _model(spark, sf_dir):
    rows = training.training_pairs(_some(spark, sf_dir).select(*PAIRS), proxy.truth(spark, sf_dir))
    held = materialize(features.features(rows, *proxy.sides(spark, sf_dir)), "features")
    return training.train(held), held


@query()
def gbt_score(spark, sf_dir):
    """The training pairs with probabilities and the decision."""
    model, held = _model(spark, sf_dir)
    return training.scored(model, held).select("s1_id", "target_id", "label", "split", F.round("probability", 6).alias("probability"), (F.col("probability") >= training.THRESHOLD).alias("matched"))


@query()
def feature_importance(spark, sf_dir):
    """L4, W11."""
    return training.importances(_model(spark, sf_dir)[0], spark)


# --- outputs and profiles ----------------------------------------------------------------------


@query(pairs_sql(REC, "nx") + " SELECT r.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT target_id, ',' ORDER BY target_id), '') AS matched_entity_ids FROM rec r LEFT JOIN pairs p ON r.entity_id = p.s1_id WHERE src = 0 GROUP BY 1")
def match_list_output(spark, sf_dir):
    """SK4, A7."""
    return tables.id_lists(block_with(spark, sf_dir, "nx"), proxy.sides(spark, sf_dir)[0])


@query(f"WITH {REC}, {TRUTH}, {_LISTS} SELECT l.source1_entity_id AS s1_id, unnest(list_filter(list_transform(string_split(matched_entity_ids, ','), lambda x: trim(x)), lambda x: x <> '')) AS target_id FROM lists l")
def truth_list_pairs(spark, sf_dir):
    """X24."""
    return evaluation.truth_pairs(proxy.lists(spark, sf_dir))


@query(f"""WITH {REC}, {TRUTH}, {_LISTS}, n AS (SELECT len(list_filter(string_split(matched_entity_ids, ','), lambda x: trim(x) <> '')) AS n FROM lists)
SELECT count(*) AS records, count(*) FILTER (n = 0) AS singletons, count(*) FILTER (n > 0) AS with_matches, max(n)::INT AS most, round(avg(n), 9) AS mean FROM n""")
def match_count_distribution(spark, sf_dir):
    """A13."""
    return profiling.match_counts(proxy.lists(spark, sf_dir))


@query("""SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS "column", unnest(['bigint', 'string', 'string', 'string', 'bigint']) AS type,
  unnest([count(*) FILTER (doc_id IS NULL), count(*) FILTER (text IS NULL), count(*) FILTER (lang IS NULL), count(*) FILTER (source IS NULL), count(*) FILTER (n_chars IS NULL)]) AS nulls, count(*) AS rows FROM documents""")
def profile_nulls(spark, sf_dir):
    """A15."""
    return profiling.null_counts(proxy.table(spark, sf_dir, "documents"))


@query("SELECT count(*) AS rows, count(DISTINCT text) AS keys, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def profile_duplicates(spark, sf_dir):
    """A14."""
    return profiling.duplicates(proxy.table(spark, sf_dir, "documents"), "text")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 10")
def value_counts(spark, sf_dir):
    """The ten most frequent sources."""
    return profiling.value_counts(proxy.table(spark, sf_dir, "documents"), "source", 10)


@query("SELECT lang, count(n_chars) AS count, round(avg(n_chars), 9) AS mean, round(stddev_samp(n_chars), 9) AS std, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, max(n_chars) AS max FROM documents GROUP BY 1")
def grouped_describe(spark, sf_dir):
    """A11."""
    return evaluation.described(proxy.table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1")
def share_histogram(spark, sf_dir):
    """A19."""
    return evaluation.histogram(proxy.table(spark, sf_dir, "documents"), "lang")
