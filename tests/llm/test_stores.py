"""Sharding, mixing, media, WARC and the pipeline."""

import hashlib
import io
import math
import random
import struct
import sys
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kindred.llm import media, mixing, sharding, warc
from kindred.llm.common import range_index, ranges, work_dir

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "Ünï  çode", "same", "same", "x" * 5000, "w " * 3000, "y" * 64, "z" * 128]


def least_capacity(sizes, shards):
    @lru_cache(None)
    def best(i, k):
        return sum(sizes[i:]) if k == 1 else min(max(sum(sizes[i:j]), best(j, k - 1)) for j in range(i, len(sizes) + 1))

    return best(0, shards)


def test_cuts_are_minimax():
    rng = random.Random(1)
    for _ in range(400):
        sizes, shards = [rng.choice([0, 1, 2, 30, rng.randint(0, 30)]) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)
        cuts = [0, *sharding.minimax_cuts(sizes, shards), len(sizes)]
        assert cuts == sorted(cuts) and len(cuts) == shards + 1
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == least_capacity(tuple(sizes), shards) == sharding.smallest_capacity(sizes, shards)


@pytest.mark.parametrize(("first_bits", "single", "around"), [(16, 100_000, 4), (3, 0, 0), (1, 60, 1), (3, 0, 50)])
def test_shards_are_minimax(spark, monkeypatch, first_bits, single, around):
    """The largest shard is the least possible one over the groups of equal texts in hash order."""
    monkeypatch.setattr(sharding, "SINGLE_ROWS", single)
    monkeypatch.setattr(sharding, "AROUND", around)
    rng = random.Random(first_bits)
    rows = [(i, f"{rng.randrange(400)} " * rng.choice([1, 5, 20, 90])) for i in range(1200)] + [(i, "hot text " * 40) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard(docs, first_bits=first_bits).collect()
    groups = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 1).alias("n")).sort("h").collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    best = sharding.smallest_capacity([r.n for r in groups], 8)
    assert max(sizes.values()) == best and best == smallest_by_trial([r.n for r in groups], 8)


def smallest_by_trial(sizes, shards):
    """Every sum of neighbours is tried as a capacity, from below, by filling shards one after the other."""
    for capacity in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, min(len(sizes), i + 2 + len(sizes) // 2) + 1)}):
        if capacity * shards < sum(sizes) or capacity < max(sizes):
            continue
        used, held = 1, 0
        for n in sizes:
            used, held = (used, held + n) if held + n <= capacity else (used + 1, n)
        if used <= shards:
            return capacity


def test_shard(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "hot") for i in range(300)] + [(1000 + i, f"text {i} " * (i % 20)) for i in range(600)] + [(None, "n"), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).repartition(4)
    found = sharding.shard(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    slots, by_text, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        by_text[r.size, r.text_crc32].add(r.shard)
        sizes[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in by_text.values())
    assert set(slots) <= set(range(8)) and max(sizes.values()) - min(sizes.values()) <= max(r.size for r in found)
    assert not sharding.shard(docs.limit(0)).count()


def test_range_index(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("v"))
    cuts = [0, 5, 100, 5000, 900_000]
    assert all(r.p == bisect_right(cuts, r.v) for r in rows.select("v", range_index(F.col("v"), cuts).alias("p")).collect())
    assert rows.select(range_index(F.lit(None).cast("long"), cuts).alias("p")).first().p == 0


@pytest.mark.parametrize("nulls_first", [False, True])
def test_ranges(spark, nulls_first):
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, rng.randrange(1000)]), rng.random()) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "v long, f double")
    cut = ranges(frame, "v", 9, nulls_first)
    found = frame.withColumn("pid", cut.pid(F.col("v"), F.col("f"))).collect()
    order = sorted(found, key=lambda r: ((r.v is None) != nulls_first, r.v or 0, r.f))
    assert [r.pid for r in order] == sorted(r.pid for r in found)
    sizes = Counter(r.pid for r in found)
    assert max(sizes) < cut.count <= 16 and max(sizes.values()) < 700
    assert ranges(frame.limit(0), "v", 9).count == 2


def filled(sizes, weights):
    """Targets by repeated sharing: what is above its limit is held there, the rest is shared again."""
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in held]
        left = total - sum(held.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return {**held, **share}
        held |= {s: 3.0 * sizes[s] for s in above}


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(1500)] + [(5000 + i, t, "odd") for i, t in enumerate(ODD)] + [(9000, "one two", "tiny"), (None, "x y", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit(3)).withColumn("size", F.lit(9))
    found = mixing.mix(docs).collect()
    size = lambda t: len((t or "").replace(" ", "x").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and r.taken <= 3 * r.size
    for s in sizes:
        own = [size(t) for _, t, x in rows if x == s]
        assert abs(taken[s] - goal[s]) <= (10 if len(own) > 100 else max(own))
    assert len(found) == len(rows) and sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, found), key=str)
    assert not mixing.mix(docs.limit(0)).count()
    many = mixing.mixed(docs)
    assert many.columns == docs.columns and {(r.place, r.size) for r in many.collect()} == {(3, 9)}
    assert Counter(r.doc_id for r in many.collect()) == Counter({r.doc_id: r.times for r in found if r.times})


def test_equal_rows_are_taken_one_by_one(spark):
    """A source of null ids, of one size, and of wholly equal rows still comes near its target, whatever the layout."""
    rows = [(None, f"w{i} b c d", "a") for i in range(300)] + [(7, "same five words as ever", "b")] * 3000 + [(i, "w " * (i % 50), "c") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    goal, taken = {r.source: r.target for r in found}, Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - goal[s]) <= 5 for s in goal) and len({r.times for r in found if r.source == "b"}) == 2
    again = Counter(tuple(r)[:5] for r in mixing.mix(docs.repartition(5)).collect())
    assert again == Counter(tuple(r)[:5] for r in found)
    assert Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect()) == sum((Counter({(r.doc_id, r.source): r.times}) for r in found), Counter())


def test_mix_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == wanted


def plain_png(data):
    """Another reader: chunks one after the other, every filter of the standard undone, one sample at a time."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    chunks, rest = [], data[8:]
    while rest:
        n = int.from_bytes(rest[:4], "big")
        assert zlib.crc32(rest[4 : 8 + n]) == int.from_bytes(rest[8 + n : 12 + n], "big")
        chunks.append((rest[4:8], rest[8 : 8 + n]))
        rest = rest[12 + n :]
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    wide, high = (int.from_bytes(chunks[0][1][i : i + 4], "big") for i in (0, 4))
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])  # 8-bit samples, grey, not interlaced
    raw = zlib.decompress(b"".join(x for kind, x in chunks if kind == b"IDAT"))
    out, above = bytearray(), bytes(wide)
    assert len(raw) == high * (wide + 1)
    for y in range(high):
        kind, row = raw[y * (wide + 1)], bytearray(raw[y * (wide + 1) + 1 : (y + 1) * (wide + 1)])
        for x in range(wide):
            a, b = row[x - 1] if x else 0, above[x]
            row[x] = (row[x] + {0: 0, 1: a, 2: b, 3: (a + b) // 2}[kind]) % 256
        out += row
        above = bytes(row)
    return bytes(out)


def plain_feature(data):
    n, mean = len(data), sum(data) / len(data)
    spread = math.sqrt(sum((x - mean) ** 2 for x in data) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(data).values())
    flat = sum(a == b for a, b in zip(data, data[1:])) / (n - 1)
    return [1000 * x for x in (mean, spread, entropy, flat)]


def test_png_round_trip():
    for n in (64, 640, 64 * 999):
        payload = random.Random(n).randbytes(n)
        assert media.from_png(media.to_png(payload)) == plain_png(media.to_png(payload)) == payload
        media.check_png(media.to_png(payload))
    bad = bytearray(media.to_png(bytes(64)))
    bad[50] ^= 1
    for wrong in (b"no image", bytes(bad), media.to_png(bytes(64))[:-12]):
        with pytest.raises((ValueError, struct.error)):
            media.check_png(wrong)
    with pytest.raises(ValueError):
        media.from_png(bytes(bad))


def test_media(spark):
    rows = list(enumerate(ODD)) + [(None, "n"), (3, "a"), (3, "a"), (50, "long é " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("m")).repartition(3)
    folder = work_dir(spark, "media-test")
    media.media_features(docs.limit(5), folder).count()
    found = media.media_features(docs, folder).collect()  # what lies in the folder already doesn't count
    stored = {}
    for r in spark.read.format("media_archive").load(folder).collect():
        stored[hashlib.sha256(r.media).hexdigest()] = bytes(r.media)
    wanted = Counter()
    for key, text in rows:
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        wanted[key, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter(tuple(r)[:5] for r in found) == wanted
    for r in found:
        payload = plain_png(stored[r.media_sha256])
        assert (hashlib.sha256(payload).hexdigest(), len(stored[r.media_sha256])) == (r.payload_sha256, r.media_bytes)
        assert all(abs(float(x.split("=")[1]) - y) <= 0.5001 for x, y in zip(r.feature.split(","), plain_feature(payload), strict=True))
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in found}) == len({r.payload_sha256 for r in found})
    assert not media.media_features(docs.limit(0)).count()


def test_media_that_misses_members(spark):
    folder = work_dir(spark, "media-test")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    media.write_archives(docs, folder)
    store, root = media.opened(folder)
    name = media.ArchiveReader({"path": folder}).partitions()[0].archive
    index = media.pq.read_table(f"{root}/{name}.idx", filesystem=store)
    media.pq.write_table(index.slice(1), f"{root}/{name}.idx", filesystem=store)
    spark.dataSource.register(media.MediaArchives)
    with pytest.raises(Exception, match="Incomplete"):
        spark.read.format("media_archive").load(folder).collect()


def test_media_ranges_and_retries(spark, monkeypatch):
    folder = work_dir(spark, "media-test")
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(200)], "doc_id long, text string")
    media.write_archives(docs, folder, roll_bytes=20_000)
    spark.dataSource.register(media.MediaArchives)
    found = spark.read.format("media_archive").option("rangebytes", "3000").load(folder)
    assert sorted(r.doc_id for r in found.collect()) == list(range(200)) and found.rdd.getNumPartitions() > 20

    reader = media.ArchiveReader({"path": folder, "wait": "0"})
    parts = reader.partitions()
    store, root = media.opened(folder)
    opens, real = [], store.open_input_file

    class Flaky:
        """Every file read fails the first time at one offset."""

        def open_input_file(self, path):
            opens.append(path)
            held = real(path)

            class Short:
                def seek(self, at):
                    held.seek(at)

                def read(self, n):
                    return held.read(n)[: -1 if len(opens) == 1 else None]

                def close(self):
                    held.close()

            return Short()

    index = media.pq.read_table(f"{root}/{parts[0].archive}.idx", filesystem=store).to_pylist()[0]
    data = reader.member(Flaky(), f"{root}/{parts[0].archive}", [], index["offset"], index["size"])
    assert len(data) == index["size"] and len(opens) == 2
    with pytest.raises(OSError):
        reader.member(store, f"{root}/{parts[0].archive}", [], index["offset"], index["size"] + 1)


def test_warc(spark):
    same = "<html>" + "s" * 100
    rows = [(3, "http://x/3", same), (1, "http://x/1", same), (2, None, same), (4, "u 4%\r\nX: y", "short"), (5, "http://x/5", "short"), (6, "http://é/6", None), (7, "", "é" * 200), (None, "http://n", same), (1, "http://x/1", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    folder = work_dir(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, roll_bytes=300)
    found = warc.read_archives(manifest, folder).collect()
    assert Counter((r.page_id, r.url) for r in found) == Counter((k, u) for k, u, _ in rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in found}
    assert kinds == {(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)}
    for r in found:
        html = next((h for k, u, h in rows if (k, u) == (r.page_id, r.url)), None) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert r.html == (html if r.record_type == "response" else None)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 2
    store, root = warc.opened(folder)
    names = [x.base_name for x in store.get_file_info(warc.fs.FileSelector(root)) if x.is_file]
    assert sorted(names) == sorted(r.file for r in manifest.collect())  # no temporary names are left

    headers = []
    for n in names:
        with store.open_input_stream(f"{root}/{n}", compression=None) as stream:
            data = stream.read()
        members = [x for *_, x in warc.members(io.BytesIO(data), len(data))]
        assert b"WARC-Type: warcinfo" in members[0] and f"WARC-Filename: {n}".encode() in members[0]
        headers += [dict(x.split(": ", 1) for x in m.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for m in members]
    by_id = {h["WARC-Record-ID"]: h for h in headers}
    assert len(by_id) == len(headers) == len(rows) + len(names)
    for h in headers:
        if h["WARC-Type"] == "revisit":
            there = by_id[h["WARC-Refers-To"]]
            assert (there["WARC-Type"], there["X-Page-ID"], there["WARC-Target-URI"]) == ("response", h["X-Refers-To-Page-ID"], h["WARC-Refers-To-Target-URI"])

    again = work_dir(spark, "warc-test")
    warc.write_archives(pages.repartition(5), again, roll_bytes=300)
    read = lambda f, n: warc.opened(f)[0].open_input_stream(f"{warc.opened(f)[1]}/{n}", compression=None).read()
    assert all(read(folder, n) == read(again, n) for n in names)
    assert not warc.read_archives(warc.write_archives(pages.limit(0), work_dir(spark, "warc-test")), folder).count()


def test_bad_records():
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parsed(data, True)[:4] == (1, "u", 7, hashlib.sha256(b"payload").hexdigest())
    with pytest.raises(warc.BadRecord):
        warc.parsed(data.replace(b"payload\r", b"paYload\r"), True)
    whole = warc.gzip_member(data) * 2
    assert [x[:2] for x in warc.members(io.BytesIO(whole), len(whole))] == [(0, len(whole) // 2), (len(whole) // 2, len(whole) // 2)]
    with pytest.raises(warc.BadRecord):
        list(warc.members(io.BytesIO(whole[:-5]), len(whole) - 5))


@pytest.mark.parametrize("name", ["op1_chat_link", "op7_mix", "op8_warc"])
def test_queries_match_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = entry.queries()[name](spark, SF)
    result = base.execute(entry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    plain = lambda row: str([round(x, 6) if isinstance(x, float) else x for x in row])
    assert sorted(plain(r) for r in frame.select(*order).collect()) == sorted(plain(r) for r in result.fetchall())


def test_pipeline(spark):
    import corpus_pipeline
    from kindred.llm import minhash, packing, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = steps[name] = stage(spark, docs, SF).cache()
        assert docs.count()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect())
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in entry.queries()["pipeline"](spark, SF).collect()) == pieces
    first, second, third, last = steps.values()
    assert first.columns == second.columns == third.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    assert first.join(clean, "doc_id").count() >= 0.97 * clean.count()
    texts = {r.doc_id: r.text for r in first.collect()}
    keys = sorted(texts)
    sets = dict(zip(keys, minhash.weighted([texts[k] for k in keys]), strict=True))
    kept = {r.doc_id for r in second.collect()}
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if minhash.similarity(sets[a], sets[b]) >= 0.8]
    assert not any(a in kept and b in kept for a, b in links)
    assert all(k in kept for k in keys if not any(k in x for x in links))
    assert set(r.doc_id for r in third.collect()) <= kept
    assert last.agg(F.count_distinct("doc_id")).first()[0] == third.select("doc_id").distinct().count()
    assert quality.CUT and packing.WINDOW == 2048


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, an empty table and clashing names, from end to end."""
    import corpus_pipeline

    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(12)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)] + [(5, texts[5], "en", "src1", 1)] * 2
    rows += [(None, texts[0], None, None, None), (None, texts[0] + " more", None, None, None), (20, None, "en", None, 0), (21, "", None, "src2", 0), (22, "long words " * 100_000, "en", "src2", 1), (-1, "m n o", "en", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, extra in (("documents", lambda d: d.withColumn("size", F.lit("s")).withColumn("a.b", F.lit(1)).withColumn("node", F.lit(None).cast("int"))), ("empty", lambda d: d.limit(0))):
        folder = tmp_path / name
        extra(docs).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, 1, 0), (1, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, str(folder)).collect()
        if name == "empty":
            assert not found
            continue
        kept = Counter(r.doc_id for r in found if r.start == 0)
        assert kept.keys() <= {*range(12), -1, 20, 22} and {0, 5, 22, -1} <= kept.keys()
        held = Counter()
        for r in found:
            held[r.sequence_id] += r.length
        assert max(held.values()) <= 2048 and sorted(held) == list(range(len(held)))


def test_entry_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "kindred", tmp_path / "kindred", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True).stdout
    assert "block_exact_name" in said and "op1" not in said and "pipeline" not in said
