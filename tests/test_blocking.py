"""Blocking against a row-at-a-time restatement, and the laws of caps, ranks and recall."""

import dataclasses
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.functions import text
from kindred.operators import blocking, evaluation, keys, ranking
from kindred.streaming import scoring

NAMES = ["Acme", "Delta", "Tools", "Energy", "Foods", "North", "Solar", "Café", "Ltd", "Inc", "Pvt", "Zürich", "Trade", "12"]
PLACES = ["main", "road", "12b", "560001", "indiranagar", "market", "7", "harbour", "hill", "station", "4400", "west"]


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = " ".join(rng.choices(NAMES, k=rng.randint(0, 4)))
        address = ", ".join(rng.choices(PLACES, k=rng.randint(0, 5)))
        rows.append((f"E{seed}-{i}", name or None, address, rng.choice(["US", "us ", "FR"])))
    return rows


def record_tables(spark, a=60, b=120):
    schema = "entity_id string, business_name string, business_address string, country string"
    return spark.createDataFrame(made(a, 1), schema), spark.createDataFrame(made(b, 2), schema)


SUFFIXES = set("pvt ltd private limited llc inc corp corporation co company gmbh llp plc lp".split())
GENERIC = set("road street avenue drive lane floor building block city district state country area plot unit shop near opposite main north south east west".split())


def normal(s):
    return " ".join(re.sub(r"[^\w\s]", " ", (s or "").casefold()).split())


def grams(s, n):
    s = s.replace(" ", "")
    return {s[i : i + n] for i in range(max(1, len(s) - n + 1))} if s else set()


def parts(row):
    key, name, address, country = row
    words = [w for w in re.findall(r"\w+", normal(name)) if w not in SUFFIXES]
    address = normal(address)
    useful = [w for w in re.findall(r"\w+", address) if (any(c.isdigit() for c in w) or len(w) >= 4) and w not in GENERIC]
    return key, " ".join(words), words, address, useful, country.strip().casefold()


def plain_keys(row, gram_df=None, token_df=None):
    """The signals of the latest generation but aa and nt; with frequencies for a primary record."""
    _, name, words, address, useful, country = parts(row)
    out = set()
    strong = sorted(set(useful), key=lambda w: (-len(w), w))[:5]
    numbers = re.findall(r"\d+[a-zA-Z]?", address)
    if words:
        out |= {("nx", name), ("ns", " ".join(sorted(set(words))))}
        if len("".join(words)) >= 6:
            out.add(("nc", "".join(words)))
        if len(words[0]) >= 2:
            out.add(("ua", f"{words[0]}|{words[-1]}"))
    if gram_df is None:
        out |= {("ng", g) for g in grams(name, 3)} | {("ar", t) for t in strong[:3]}
    else:
        count = lambda g: gram_df[country][g]
        rare = sorted((g for g in grams(name, 3) if 0 < count(g) <= 500), key=lambda g: (count(g), g))[:8]
        if len(rare) < 5:
            rest = sorted((g for g in grams(name, 3) if 0 < count(g) <= 5000 and g not in rare), key=lambda g: (count(g), g))
            rare = (rare + rest)[:8]
        out |= {("ng", g) for g in rare}
        seen = token_df[country]
        out |= {("ar", t) for t in sorted((t for t in set(useful) if 0 < seen[t] <= 1000), key=lambda t: (seen[t], -len(t), t))[:3]}
    out |= {("ap", "|".join(sorted((a, b)))) for i, a in enumerate(strong) for b in strong[i + 1 :]}
    out |= {("an", f"{n}|{t}") for n in numbers[:3] for t in strong[:3]} | {("ah", f"{n}|{t}") for n in numbers[:2] for t in strong[:2]}
    out |= {("pc", p) for p in re.findall(r"\b\d{4,6}\b", address)}
    if len(address.replace(" ", "")) >= 8:
        out |= {("ag", g) for g in sorted(grams(address, 4))[:4]}
    return {(sig, country, payload) for sig, payload in out}


def plain_candidates(s1, targets, caps):
    gram_df, token_df = defaultdict(Counter), defaultdict(Counter)
    for row in s1:
        _, name, _, _, useful, country = parts(row)
        gram_df[country].update(grams(name, 3))
        token_df[country].update(set(useful))
    postings = defaultdict(set)
    for row in targets:
        for key in plain_keys(row):
            postings[key].add(row[0])
    out = defaultdict(set)
    for row in s1:
        for key in plain_keys(row, gram_df, token_df):
            if len(postings.get(key, ())) <= caps[key[0]]:
                for target in postings.get(key, ()):
                    out[row[0], target].add(key[0])
    return {pair: len(signals) for pair, signals in out.items()}


@pytest.mark.parametrize("cap", [3, 300])
def test_latest_generation(spark, cap):
    caps = dict.fromkeys(keys.CAPS_4, cap)
    signals = tuple(s for s in keys.SIGNALS_4 if s not in ("aa", "nt"))
    s1, targets = record_tables(spark)
    wanted = plain_candidates(made(60, 1), made(120, 2), caps)
    for keyed in ("text", "xxhash64", "crc32"):
        found = blocking.block(s1, targets, keys.Blocking("v4", signals, caps, keyed=keyed)).collect()
        assert {(r.s1_id, r.target_id): r.n_signals for r in found} == wanted


@pytest.mark.parametrize("config", [keys.V4, keys.V3, keys.V1, keys.MULTI])
def test_generations_find_equal_records(spark, config):
    s1, _ = record_tables(spark)
    copies = s1.withColumn("entity_id", F.concat(F.lit("T"), "entity_id"))
    found = blocking.block(s1, copies, config)
    named = s1.where("business_name IS NOT NULL").count()
    own = found.where(F.concat(F.lit("T"), "s1_id") == F.col("target_id")).count()
    assert own >= named * 0.8
    assert found.agg(F.max("n_signals")).first()[0] <= len(config.signals)


def early_keys(row, generation, known=None):
    """v1's and v3's keys with their repeats, as (signal, CRC-32 of the text that names it)."""
    _, name, words, address, _, country = parts(row)
    spelled = text.transliterated(name).lower().strip()
    if generation == "v3" and name.isascii():
        spelled = ""
    elif generation == "v3":
        spelled = " ".join(re.findall("[a-z0-9]+", spelled))
    plain = re.findall("[a-z0-9]+", unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().casefold())
    cut = 5 if generation == "v3" else None
    least = lambda found, n: [str(h) for h in sorted({zlib.crc32(g.encode()) for g in found})[:n]]
    old = {w for w in GENERIC if w not in ("near", "opposite", "main", "north", "south", "east", "west")}
    useful = [w for w in re.findall(r"\w+", address) if (any(c.isdigit() for c in w) or len(w) >= 4) and w not in old]
    numbers, out = re.findall(r"\d+[a-zA-Z]?", address), []
    if words:
        out += [("nx", " ".join(words)), ("ns", " ".join(sorted(set(words))))]
        if len("".join(words)) >= 6:
            out.append(("nc", "".join(words)))
    for sig, found in (("ua", words), ("aa", plain)):
        if found and len(found[0]) >= 2:
            out.append((sig, f"{found[0][:cut]}|{found[-1][:cut]}"))
    if generation == "v3":
        out += [("ng", h) for h in least(grams(name, 3), 8)] + [("nt", h) for h in least(grams(spelled, 3), 6)]
        useful = [w for w in useful if len(w) >= 5 and (known is None or w in known)]
        strong = sorted(set(useful), key=lambda w: (-len(w), w))[:5]
        out += [("ap", f"{a}|{b}") for i, a in enumerate(strong) for b in strong[i + 1 :]]
        out += [("an", f"{n}|{t}") for n in numbers[:3] for t in useful[:3]] + [("ah", f"{n}|{t}") for n in numbers[:2] for t in strong[:2]]
        out += [("pc", p) for p in re.findall(r"\b\d{4,6}\b", address)]
        if len(address.replace(" ", "")) >= 8:
            out += [("ag", h) for h in least(grams(address, 4), 4)]
    else:
        clean = " ".join(w for w in re.findall(r"\w+", spelled) if w not in SUFFIXES)
        out += [("ng", h) for h in least(grams(name, 4), 4)] + ([("nt", clean)] if clean else [])
        useful = sorted({w for w in useful if known is None or w in known})[:4]
        numbers = sorted({n for n in numbers if known is None or n in known})[:2]
        out += [("ap", f"{a}|{b}") for i, a in enumerate(useful) for b in useful[i + 1 :]] + [("an", f"{n}|{t}") for n in numbers for t in useful]
    return [(sig, zlib.crc32(f"{sig}|{country}|{payload}".encode())) for sig, payload in out]


@pytest.mark.parametrize("generation", ["v1", "v3"])
@pytest.mark.parametrize("cap", [3, 300])
def test_early_generations(spark, generation, cap):
    """Keys meet by hash, and a record's repeated keys fill a posting list."""
    config = dataclasses.replace({"v1": keys.V1, "v3": keys.V3}[generation], caps=dict.fromkeys(keys.CAPS_4, cap))
    s1, targets = record_tables(spark)
    left, right = made(60, 1), made(120, 2)
    words = [parts(r)[3] for r in left]
    old = {w for w in GENERIC if w not in ("near", "opposite", "main", "north", "south", "east", "west")}
    known = {w for a in words for w in re.findall(r"\w+", a) if (any(c.isdigit() for c in w) or len(w) >= 4) and w not in old} | {n for a in words for n in re.findall(r"\d+[a-zA-Z]?", a)}
    postings, wanted = defaultdict(list), defaultdict(set)
    for row in right:
        for _, key in early_keys(row, generation, known):
            postings[key].append(row[0])
    for row in left:
        for sig, key in early_keys(row, generation, known if generation == "v3" else None):
            if len(postings.get(key, ())) <= cap:
                for target in postings.get(key, ()):
                    wanted[row[0], target].add(sig)
    found = blocking.block(s1, targets, config).collect()
    assert {(r.s1_id, r.target_id): r.n_signals for r in found} == {pair: len(x) for pair, x in wanted.items()}


def plain_char_keys(row):
    _, name, address, country = row
    words = f" {' '.join(normal(name).split())} "
    for phrase in ("private limited", "pvt ltd"):
        words = words.replace(f" {phrase} ", " ")
    legal = set("pvt limited ltd llc llp inc incorporated corporation corp company co plc gmbh".split())
    name, address, country = " ".join(w for w in words.split() if w not in legal), normal(address), country.strip().casefold()
    padded = f" {name} "
    out = {("exact_name", name)} | {("char_name", padded[i : i + 3]) for i in range(len(padded) - 2)} if name else set()
    out |= {("addr_token", w) for w in re.findall(r"\w+", address) if any(c.isdigit() for c in w) or len(w) >= 3}
    return {(sig, country, k) for sig, k in out | {("addr_number", n) for n in re.findall(r"\d+[a-zA-Z]?", address)}}


@pytest.mark.parametrize("cap", [4, 300])
def test_char_candidates(spark, cap):
    s1, targets = record_tables(spark)
    postings, votes = defaultdict(list), defaultdict(Counter)
    for row in made(120, 2):
        for key in plain_char_keys(row):
            postings[key].append(row[0])
    for row in made(60, 1):
        for key in plain_char_keys(row):
            ids = sorted(postings[key])[:cap] if key[0] == "exact_name" else postings[key] if len(postings[key]) <= cap else []
            votes[row[0], key[0]].update(ids)
    wanted = Counter()
    for (key, sig), found in votes.items():
        first = sorted(found, key=lambda t: (-found[t], t))[: cap if sig in ("char_name", "addr_token") else None]
        wanted.update((key, t) for t in first)
    assert {(r.s1_id, r.target_id): r.n_signals for r in blocking.char_candidates(s1, targets, cap).collect()} == dict(wanted)


SCHEMA = "entity_id string, business_name string, business_address string, country string"


def test_transliterated_names_meet(spark):
    s1 = spark.createDataFrame([("a", "Москва", "", "RU"), ("b", "Moskva", "", " ru"), ("c", "Тула", "", "RU"), ("d", None, "", "RU")], SCHEMA)
    targets = spark.createDataFrame([("x", "МОСКВА", "", "RU"), ("y", "moskva LTD", "", "RU"), ("z", "Moskva", "", "US"), ("w", "", "", None)], SCHEMA)
    found = {(r.s1_id, r.target_id, r.probe) for r in blocking.transliterated_matches(s1, targets).collect()}
    assert found == {(s, t, "spelled") for s in "ab" for t in "xy"} | {("b", "x", "plain"), ("b", "y", "plain")}


def test_lift_of_transliterated_keys(spark):
    s1 = spark.createDataFrame([("a", "Москва", "", "RU"), ("b", "Delta", "", "US")], SCHEMA)
    targets = spark.createDataFrame([("x", "Moskva", "", "RU"), ("y", "Delta", "", "US")], SCHEMA)
    plain, spelled = (blocking.block(s1, targets, c) for c in (keys.AB_PLAIN, keys.AB_SPELLED))
    row = evaluation.lift(spark.createDataFrame([("a", "x"), ("b", "y")], "s1_id string, target_id string"), plain, spelled).first()
    assert (row.pairs_before, row.pairs_after, row.extra_true_pairs, row.lift, row.verdict) == (1, 2, 1, 0.5, "KEEP")


def test_empty_tables(spark):
    s1, targets = record_tables(spark)
    assert not blocking.block(s1.limit(0), targets).count()
    assert not blocking.block(s1, targets.limit(0), keys.V1).count()


def test_caps(spark):
    rows = [(f"t{i}", "pc", "k301") for i in range(301)] + [(f"t{i}", "pc", "k300") for i in range(300)]
    postings = spark.createDataFrame(rows, "entity_id string, sig string, key string")
    assert {(r.key, r["count"]) for r in blocking.within_caps(postings, keys.CAPS_4).groupBy("key").count().collect()} == {("k300", 300)}
    kept = blocking.truncated(postings, 300)
    assert {(r.key, r["count"]) for r in kept.groupBy("key").count().collect()} == {("k300", 300), ("k301", 300)}
    left_out = {r.entity_id for r in postings.where("key = 'k301'").join(kept.where("key = 'k301'"), ["entity_id", "key"], "left_anti").collect()}
    assert left_out == {max(f"t{i}" for i in range(301))}


def test_top(spark):
    pairs = spark.createDataFrame([("a", f"t{i:03d}", i % 7) for i in range(100)], "s1_id string, target_id string, votes int")
    found = ranking.top(pairs, 20, F.col("votes").desc(), F.col("target_id")).orderBy("rank").collect()
    wanted = sorted(((f"t{i:03d}", i % 7) for i in range(100)), key=lambda x: (-x[1], x[0]))[:20]
    assert [(r.target_id, r.votes) for r in found] == wanted
    assert [r.rank for r in found] == list(range(1, 21))


def test_recalls(spark):
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "gone")], "s1_id string, target_id string")
    s1 = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    targets = spark.createDataFrame([("x",), ("y",), ("z",)], "entity_id string")
    pairs = spark.createDataFrame([("a", "x", 3, 2), ("b", "x", 1, 1)], "s1_id string, target_id string, mask int, n_signals int")
    r = evaluation.recall(truth, pairs, s1, targets).first()
    assert (r.true_pairs, r.indexed_pairs, r.recovered, r.full_recall) == (4, 3, 1, 0.25)
    assert evaluation.not_indexed(truth, targets).collect() == [("c", "gone")]
    assert evaluation.missed(truth, pairs).count() == 3
    empty = evaluation.recall(truth.limit(0), pairs, s1, targets).first()
    assert (empty.true_pairs, empty.full_recall) == (0, 0.0)
    assert [r.n for r in evaluation.candidate_counts(pairs, s1).orderBy("s1_id").collect()] == [1, 1, 0]
    assert evaluation.record_recall(truth, pairs, s1).first().all_found == 0


def test_tfidf_is_cosine(spark):
    schema = "entity_id string, c string"
    left, right = spark.createDataFrame([("a", "blue sky"), ("b", "")], schema), spark.createDataFrame([("x", "blue sky"), ("y", "blue sea"), ("z", "red")], schema)
    found = ranking.cosine_top(ranking.tfidf(left, F.col("c"), right, min_df=1), ranking.tfidf(right, F.col("c"), min_df=1), 2).orderBy("rank").collect()
    assert [(r.s1_id, r.target_id) for r in found] == [("a", "x"), ("a", "y")]
    assert found[0].cosine == pytest.approx(1) and 0 < found[1].cosine < 1


def test_stream_gives_the_batch_pairs(spark, tmp_path):
    s1, targets = record_tables(spark)
    targets.repartition(3).write.parquet(str(tmp_path / "in"))
    live = scoring.live_keys(s1, targets)
    stream = spark.readStream.schema(targets.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scoring.stream_candidates(stream, live, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = {tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / "out")).select("s1_id", "target_id", "mask", "n_signals").collect()}
    assert found == {tuple(r) for r in blocking.block(s1, targets).select("s1_id", "target_id", "mask", "n_signals").collect()}


def full_keys(spark, folder):
    """900 documents of one name, 600 of them targets, and 30 of others."""
    texts = ["abcde fghij klmno pqrst uvwxy zabcd efghi"] * 900 + [f"other{i} name" for i in range(30)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return {(f"S1-{i}", f"S{j % 3 + 1}-{j}") for i in range(0, 900, 3) for j in range(900) if j % 3}


def test_over_full_prefix_keys_keep_their_pairs(spark, tmp_path):
    from kindred.plans import catalog

    same = full_keys(spark, tmp_path)
    found = {(r.s1_id, r.target_id): r.votes for r in catalog.queries()["block_prefix_keys"](spark, str(tmp_path)).collect()}
    own = [blocking.prefix_block_keys(r) for r in catalog.proxy.sides(spark, str(tmp_path))]
    plain = {(r.s1_id, r.target_id): r.votes for r in blocking.votes(*own).collect()}
    assert same <= set(found) and found == plain


def test_names_of_many_targets_keep_their_pairs(spark, tmp_path):
    from kindred.plans import catalog

    same = full_keys(spark, tmp_path)
    found = catalog.queries()["block_name_any_country"](spark, str(tmp_path)).collect()
    assert len(found) == len(set(found)) == len(same) and {tuple(r) for r in found} == same


def test_tfidf_keeps_a_hundred_targets(spark, tmp_path):
    from kindred.plans import catalog

    texts = [f"common words of name{i}" for i in range(180)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    ranks = Counter(r["rank"] for r in catalog.queries()["tfidf_topk"](spark, str(tmp_path)).collect())
    assert ranks == {i: 60 for i in range(1, 101)}
