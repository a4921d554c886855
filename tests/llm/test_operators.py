"""The corpus operators against plain versions, on a table with every awkward case."""

import hashlib
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from joblens.llm import (
    components,
    exact_dedup,
    fingerprints,
    language,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    secrets,
    sharding,
    trigrams,
    warc,
)

WORDS = [f"{a}{b}{c}" for a in "ba ke li mo nu".split() for b in "ra se ti".split() for c in "n s".split()]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "uid string, size string, row string, key string, shard string, score string"
)
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def sentence(seed: int, words: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(30)) for i in rng.integers(0, len(WORDS), words))


def texts() -> list[str | None]:
    base = [sentence(i, 8 + 7 * (i % 9)) for i in range(60)]
    lines = [f"{base[i]}\n{base[i + 1]}\nshared line of several plain words here\n" for i in range(20)]
    near = [base[8] + " tail", base[8].replace("1", "2", 1), "start " + base[17]]
    odd = [None, "", "", "   ", "\n\n", "1 2 3", "a", "a", "ä", "\U0001f600" * 5, "x" * 3000]
    long_text = "\n".join(sentence(500 + i, 40) for i in range(120))
    keys = [
        'Password = "abcdef" token:abc secret: a.b-c=d',
        "ä AKIA" + "A1" * 10 + " api_key='" + "f0" * 14 + "'",
        "token=token: abcdefgh " + "0123456789abcdef" * 2,
    ]
    return base + lines + near + odd + [long_text, long_text + " end", *keys] + [base[3]] * 30


def table_rows() -> list[tuple]:
    extra = ("x",) * 6
    rows = [
        (i, text, ["en", "de", None][i % 3], [None, "a", "b", "é"][i % 4], len(text or ""), *extra)
        for i, text in enumerate(texts())
    ]
    return rows + [rows[5], rows[5], (None, "no id here at all", None, None, None, *extra)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(table_rows(), SCHEMA).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def by_text(docs):
    return [(row.doc_id, row.text or "") for row in docs.select("doc_id", "text").collect()]


def test_packing(docs, empty):
    path = packing.tokenizer_path()
    assert path == public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 256).collect()
    wanted = Counter()
    for doc_id, text in by_text(docs):
        ids = [*tool.encode(text, add_special_tokens=False).ids, 2]
        stops = range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)
        start = 0
        for piece, stop in enumerate(stops):
            wanted[doc_id, piece, start, np.array(ids[start:stop], "<u4").tobytes()] += 1
            start = stop
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == wanted
    sequences = defaultdict(list)
    for row in rows:
        sequences[row.sequence_id].append((row.offset, row.length))
    for members in sequences.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 256
    lengths = sorted((r.length for r in rows), reverse=True)
    assert len(sequences) <= packing.best_fit(lengths, range(len(lengths)), 256).max() + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_special_token_names_go_through_the_tokenizer():
    tool = Tokenizer.from_file(packing.tokenizer_path())
    text = "before <|endoftext|> after"
    assert packing.encoder(packing.tokenizer_path())(text) == tool.encode(text, add_special_tokens=False).ids


def test_ids_are_stored_in_half_the_bytes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    rows = [(i, " ".join(f"word{i * j}" for j in range(400))) for i in range(30)] + [(30, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs, stored = spark.read.parquet(path), {}

    def held(rows, name, plan=packing.saved):
        return stored.setdefault(name, plan(rows, name))

    plain = packing.token_pieces(docs, packing.tokenizer_path()).collect()
    with monkeypatch.context() as patch:
        patch.setattr(packing, "saved", held)
        got = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    assert {(r.doc_id, r.piece, r.length, bytes(r.ids)) for r in got} == {
        (r.doc_id, r.piece, r.length, bytes(r.ids)) for r in plain
    }
    small = stored["packing-pieces"].selectExpr("sum(length(ids)) / sum(length)").first()[0]
    assert small == 2


def test_ids_beyond_16_bits_stay_whole(spark):
    large, small = (np.array([65_535 + i, 7], "<u4").tobytes() for i in (1, 0))
    rows = [(1, 2, packing.narrowed(large)), (2, 2, packing.narrowed(small))]
    assert [len(ids) for _, _, ids in rows] == [8, 4]
    pieces = spark.createDataFrame(rows, "pid long, length long, ids binary")
    assert {r.pid: bytes(r.ids) for r in packing.widened(pieces).collect()} == {1: large, 2: small}


def test_genetic_packing_beats_or_equals_best_fit():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(150, 500, 800))[::-1].astype(np.int64)
    plain = packing.best_fit(lengths.tolist(), range(800), 1024)
    best = packing.evolve(lengths, [], 1024, 6, 3)[0]
    assert best.max() <= plain.max()
    assert np.bincount(best, lengths).max() <= 1024


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, slack=0.02).collect()
    wanted = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in by_text(docs))
    assert Counter((r.key, r.size, r.text_crc32) for r in rows) == wanted
    slots = defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def sequential_ring(rows, points, shards, limit):
    """One turn after the other: (arc, turn, size), the shard of each."""
    order = sorted({turn for _, turn, _ in rows})
    units = defaultdict(lambda: defaultdict(list))
    for arc, turn, size in rows:
        units[turn][arc].append(size)
    loads, passed, strict, current, found = [0] * shards, set(), True, None, {}
    for turn in order:
        if turn // sharding.TURNS != current:
            current, passed, strict = turn // sharding.TURNS, set(), True
        while True:
            if strict:
                least = 2 ** (sharding.CLASSES - current)
                passed |= {s for s in range(shards) if loads[s] + least > limit}
                if len(passed) == shards:
                    strict = False
            if not strict:
                passed = {s for s in range(shards) if loads[s] >= limit}
            own = sharding.owners(points, frozenset(passed))
            sums = Counter()
            for arc, sizes in units[turn].items():
                sums[own[arc]] += sum(sizes)
            full = {s for s, n in sums.items() if loads[s] + n > limit} if strict else set()
            if not full:
                break
            passed |= full
        for s, n in sums.items():
            loads[s] += n
        for arc in units[turn]:
            found[arc, turn] = own[arc]
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_loads_are_those_of_a_ring_taken_row_by_row(spark, seed):
    rng = np.random.default_rng(seed)
    shards, points = 5, sharding.of_shards(sharding.ring(6, 16), 5)
    sizes = np.concatenate([rng.integers(1, 4000, 300), [60_000] * (seed - 1)])
    rows = [
        (int(rng.integers(len(points))), int((64 - int(n).bit_length()) * sharding.TURNS + rng.integers(sharding.TURNS)), int(n))
        for n in sizes
    ]
    cells = spark.createDataFrame(rows, "arc int, turn int, size long").groupBy("arc", "turn").agg(F.sum("size").alias("size"))
    phases = sharding.bounded_loads(sharding.Cells(cells), points, shards, 0.002)
    limit = sum(sizes) / shards * 1.002
    got, loads = {}, Counter()
    for arc, turn, size in rows:
        own = [owners for since, owners in phases if since <= turn][-1]
        got[arc, turn] = own[arc]
        loads[own[arc]] += size
    assert got == sequential_ring(rows, points, shards, limit)
    assert max(loads.values()) <= limit + max(sizes)


@pytest.mark.parametrize("large", [0, 1])
def test_every_shard_keeps_its_limit_but_for_one_text(spark, tmp_path, large):
    """With a text of half a mean load, and without."""
    rng = np.random.default_rng(5)
    texts = ["x" * int(n) for n in rng.integers(0, 900, 700)]
    texts += ["y" * (sum(map(len, texts)) // 16)] * large
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    dealt = sharding.shard_documents(spark.read.parquet(str(tmp_path / "d")))
    for column, count in (("shard", 8), ("moved_to", 9)):
        loads = [r.s for r in dealt.groupBy(column).agg(F.sum("size").alias("s")).collect()]
        mean = sum(loads) / count
        assert len(loads) == count
        assert max(loads) <= 1.002 * mean + 900
        assert min(loads) >= 0.95 * mean


def test_a_hot_key_overflows_clockwise(spark, tmp_path):
    spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("abc").alias("text")
    ).write.parquet(str(tmp_path / "d"))
    rows = sharding.shard_documents(spark.read.parquet(str(tmp_path / "d")))
    sums = [r.s for r in rows.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) <= 1.01 * sum(sums) / 8 and min(sums) >= 0.97 * sum(sums) / 8


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(docs, empty):
    got = Counter(
        (r.doc_id, tuple((s.start, s.kind, s.stop) for s in r.found)) for r in secrets.scan(docs).collect()
    )
    assert got == Counter((i, tuple(plain_spans(t))) for i, t in by_text(docs))
    assert sum(len(spans) for _, spans in got) >= 5
    assert secrets.scan(empty).count() == 0


def test_secret_counts(docs):
    rows = secrets.digested(secrets.scan(docs)).collect()
    for number, rule in enumerate(secrets.RULES):
        plain = Counter((i, sum(kind == number for _, kind, _ in plain_spans(t))) for i, t in by_text(docs))
        assert Counter((r.doc_id, r[f"n_{rule.kind}"]) for r in rows) == plain
    assert all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in rows)


def test_trigram_queries():
    query = trigrams.trigram_query
    assert query("AKIA[A-Z0-9]+") == ("and", frozenset({"aki", "kia"}))
    assert query("[0-9a-f]{24,}") is True
    assert query("(?i)abc|xyz") == ("or", frozenset({"abc", "xyz"}))
    assert query("ab?cd") == ("or", frozenset({("and", frozenset({"abc", "bcd"})), "acd"}))
    assert query("(abcd)+x*") == ("and", frozenset({"abc", "bcd"}))
    assert query("a.c") is True


def test_language(spark, docs, empty, tmp_path):
    found = language.identify(docs).collect()
    for row in found:
        letters = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == "und") == (not letters) and 0 <= row.score <= 1
    assert language.identify(empty).count() == 0
    no_labels = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in no_labels.collect()} == {"und"}


def test_a_model_travels_without_its_gram_table():
    texts = [sentence(i, 30) for i in range(8)]
    model = language.fit(["a", "b"], np.arange(8) % 2, [language.presence(text) for text in texts])
    before, _ = model.scores(texts)
    sent = pickle.dumps(model)
    assert len(sent) < language.GRAMS
    after, _ = pickle.loads(sent).scores(texts)
    assert (before == after).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).where(language.held_out()).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_dedup(docs, empty, bits):
    """With 4 bits most identifiers stand for several chunks and fail verification."""
    groups = defaultdict(list)
    for doc_id, text in by_text(docs):
        groups[text].append(-1 if doc_id is None else doc_id)
    wanted = Counter(
        (i, max(ids), len(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items()
        for i in ids
    )
    rows = exact_dedup.dedup(docs, bits).collect()
    known = lambda i: -1 if i is None else i
    assert Counter((known(r.doc_id), known(r.keep_id), r.group_size, r.text_sha256) for r in rows) == wanted
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_dedup.dedup(empty).count() == 0


def test_chunk_borders_depend_on_content():
    gear = exact_dedup.gear_table()
    raw = np.random.default_rng(3).integers(0, 256, 60000).astype(np.uint8)
    one, other = exact_dedup.borders(raw, gear), exact_dedup.borders(np.r_[raw[:7], raw], gear)
    assert one[-1] == 60000 and max(np.diff([0, *one])) <= exact_dedup.LARGEST
    assert len({e + 7 for e in one} & set(other)) > len(one) / 2


def plain_targets(sizes: dict) -> dict:
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(names)}
    goal, capped = {}, set()
    budget = 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(2 * sizes[s] for s in capped)
        goal = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    sizes = Counter()
    for row in docs.collect():
        sizes[row.source] += size(row.text or "")
    wanted = plain_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, size(t)) for i, t in by_text(docs))
    goals = {r.source_size: r.target for r in rows}
    assert goals == pytest.approx({sizes[s]: wanted[s] for s in sizes})
    largest = max(r.size for r in rows)
    for total, goal in goals.items():
        taken = sum(r.size * len(r.shards) for r in rows if r.source_size == total)
        assert abs(taken - goal) <= largest
    assert max(len(r.shards) for r in rows) <= 2
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.shards)
    assert sorted(map(key, rows), key=repr) == sorted(map(key, mixing.mix(docs).collect()), key=repr)
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(len(r.shards) for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_goes_on_past_a_block_that_does_not_fit():
    """2,000 documents and one of 150,000 words, two a block; the rest is 0.3 of the source."""
    for seed in range(200):
        rng = np.random.default_rng(seed)
        sizes = rng.permutation([*rng.integers(100, 501, 2000), 150_000])
        words = np.add.reduceat(sizes, np.arange(0, len(sizes), 2))
        rest = 0.3 * words.sum()
        given, left = mixing.chosen_blocks(words, rng.random(len(words)), rest)
        assert words[given].sum() + left == pytest.approx(rest)
        assert 0 <= left < min(words[~given])
    assert mixing.chosen_documents(np.array([9, 0, 4, 3, 50]), np.array([1, 5, 9, 1, 1]), 20.0).tolist() == [1, 0, 2, 1, 0]


def test_mixing_meets_the_target_despite_a_long_document(spark, tmp_path, monkeypatch):
    sizes = [*np.random.default_rng(5).integers(1, 6, 2000).tolist(), 1500]
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)] + [(9000 + i, "", "a") for i in range(40)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    docs = spark.read.parquet(path)
    monkeypatch.setattr(mixing, "SHARE", 0.3)
    for seed in range(6):
        monkeypatch.setattr(mixing, "SEED", seed)
        found = mixing.mix(docs).collect()
        assert len(found) == len(rows)
        taken = sum(r.size * len(r.shards) for r in found)
        assert abs(taken - 0.3 * sum(sizes)) <= 5, seed
        assert 0 < sum(len(r.shards) for r in found if r.size == 0) < 40


def test_splitting_tree_keeps_both_sums():
    quotas, shards = np.array([5, 0, 17, 400]), np.array([106, 106, 105, 105])
    out = mixing.split_tree(quotas, shards, np.random.default_rng(1))
    assert (out.sum(1) == quotas).all() and (out.sum(0) == shards).all() and (out >= 0).all()


PAGES = "page_id long, url string, html string, uid string, size string"


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>" + "same " * 300, "<i>" + "ü" * 900
    rows = [(1, "http://a/1", big), (2, None, None), (3, "http://a/ü b\r\nx", "short"), (4, "http://a", "short"),
            (9, "u", big), (7, "u", big), (9, "u", big), (None, "u", big), (5, "u", other), (None, "u", "")]
    rows += [(100 + i, f"http://b/{i}", sentence(i, 50)) for i in range(40)]
    path = str(tmp_path / "pages")
    spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3).write.parquet(path)
    warc.write(spark.read.parquet(path), str(tmp_path / "warc"))
    back = warc.read(spark, str(tmp_path / "warc")).collect()
    payload = lambda html: (html or "").encode()
    digest = lambda html: hashlib.sha1(payload(html)).hexdigest()
    text = lambda i: None if i is None else str(i)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in back) == Counter(
        (text(i), len(payload(h)), digest(h)) for i, _, h in rows
    )
    revisits = sorted((r.page_id or "", r.refers_to) for r in back if r.record_type == "revisit")
    assert revisits == [("", "9"), ("1", "9"), ("7", "9"), ("9", "9")]
    stored = Counter(bytes(r.payload) for r in back if r.record_type == "response")
    assert stored[payload(big)] == 1 and stored[b"short"] == 2 and stored[b""] == 2
    first = next((tmp_path / "warc").glob("part-*")).read_bytes()
    assert int.from_bytes(first[:4], "little") == warc.DICTIONARY_MAGIC
    empty = spark.createDataFrame([], PAGES)
    warc.write(empty, str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def plain_line_dedup(rows: list[tuple]) -> list[tuple]:
    seen, out = [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in text.split("\n"):
            tokens = {t for t in line.split(" ") if t}
            if not tokens:
                kept.append(line)
                continue
            alike = any(9 * len(tokens & s) >= 4 * (len(tokens) + len(s)) for s in seen)
            seen.append(tokens)
            if not alike:
                kept.append(line)
        out.append((doc_id, "\n".join(kept)))
    return out


def test_line_dedup(docs, empty):
    rows = line_dedup.dedup_lines(docs)
    got = [(r.doc_id, r.text or "") for r in rows.select("row.doc_id", "text").collect()]
    assert Counter(got) == Counter(plain_line_dedup(by_text(docs)))
    assert rows.where("row.doc_id = 83").select("row.uid").first().uid == "x"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_the_hashes_of_a_token_set_are_independent(spark, tmp_path):
    """The second hash of a class must not start from the first."""
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string").write.parquet(path)
    lines = line_dedup.lines_of(spark.read.parquet(path))
    plan = line_dedup.saved
    held = []
    line_dedup.saved = lambda rows, name: held.append(rows) or rows
    try:
        line_dedup.classes(lines, *line_dedup.bucket_ranks(lines), line_dedup.SIMILAR)
    finally:
        line_dedup.saved = plan
    text = held[0]._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(1, tokens" in text and not re.search(r"xxhash64\(tokens#\d+L?, 1", text)


def test_line_dedup_with_frequent_tokens(spark, tmp_path):
    """Few words make every prefix token frequent."""
    rng = np.random.default_rng(11)
    rows = [
        (i, "\n".join(" ".join(rng.choice(list("abcdefghijklmn"), rng.integers(1, 12))) for _ in range(4)))
        for i in range(60)
    ]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = line_dedup.dedup_lines(docs).select("row.doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(plain_line_dedup(rows))


def test_a_group_of_near_lines_is_settled_without_all_its_pairs(spark, tmp_path, monkeypatch):
    """Lines that differ in their rarest tokens, but share the others."""
    count, rng = 300, np.random.default_rng(4)
    rows = []
    for i in range(count):
        words = [f"common{j}" for j in range(60)]
        for j in rng.choice(60, 3, replace=False):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    path = str(tmp_path / "group")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    made = {}

    def counted(table, name, plan=line_dedup.saved):
        stored = plan(table, name)
        made[name] = stored.count()
        return stored

    with monkeypatch.context() as patch:
        patch.setattr(line_dedup, "saved", counted)
        got = line_dedup.dedup_lines(spark.read.parquet(path)).select("row.doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(plain_line_dedup(rows))
    assert made["line-stars"] + made["line-pairs"] < 20 * count


def test_fingerprints(docs, empty):
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((i, len(t)) for i, t in by_text(docs))
    known = sorted(((i, t) for i, t in by_text(docs) if i is not None), reverse=True)
    unique = [i for i, n in Counter(i for i, _ in known).items() if n == 1]
    text = dict(known)
    marks = {r.doc_id: r for r in rows}
    equal = defaultdict(set)
    for i in unique:
        equal[text[i]].add(marks[i].fingerprint)
        if i - 1 in text:
            changed = fingerprints.edited(text[i], text[i - 1])
            assert marks[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    assert all(len(prints) == 1 for prints in equal.values())
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprints_estimate_generalised_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        terms = rng.integers(0, 2**63, 80, dtype=np.uint64)
        terms = np.unique(terms)
        a, b = rng.integers(0, 6, len(terms)), rng.integers(0, 6, len(terms))
        one = fingerprints.signature(terms[a > 0], a[a > 0])
        other = fingerprints.signature(terms[b > 0], b[b > 0])
        errors.append((one == other).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.1


def shingles(text: str) -> set:
    words = text.lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_near_join(docs, empty):
    rows = by_text(docs)
    sets = [shingles(t) for _, t in rows]
    near = [
        [i for i, s in enumerate(sets) if len(s & own) >= 0.8 * len(s | own)] for own in sets
    ]
    links = Counter((rows[i][0], len(near[i]) - 1) for i in range(len(rows)))
    found = ngram_join.join_near(docs).collect()
    assert Counter((r.doc_id, r.links) for r in found) == links
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in near[i]) for i in range(len(rows))]
    assert sum(r.kept for r in found) == len(set(group)) == len({r.class_id for r in found})
    assert ngram_join.join_near(empty).count() == 0


def test_near_join_over_several_blocks(docs, monkeypatch):
    whole = Counter(map(tuple, ngram_join.join_near(docs).drop("uid").collect()))
    monkeypatch.setattr(ngram_join, "BLOCK", 1)
    assert Counter(map(tuple, ngram_join.join_near(docs).drop("uid").collect())) == whole


def test_depth_is_shortened_to_the_target():
    assert ngram_join.depth_for(0.8, 0.9) == 8
    assert ngram_join.depth_for(0.8, 0.998) == 5
    assert ngram_join.depth_for(0.8, 1.0) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 60), (55, 60)]
    found = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.label for r in found} == {i: 1 for i in range(1, 31)} | {50: 50, 55: 50, 60: 50}


