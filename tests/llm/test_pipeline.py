"""The pipeline against a replay in plain Python, and stage by stage on odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
from conftest import DATA
from test_operators import ALNUM, brute_near, low
from test_texts import brute_verdict

import corpus_pipeline as p
from corpusql.llm.encoder import Encoder
from corpusql.llm.queries import vocabulary


def replay_lines(docs):
    """Later occurrences of runs of three lines (or of whole shorter texts) out, by walking all runs in order."""
    seen, out = set(), {}
    for d in sorted(docs):
        lines = docs[d].split("\n")
        n = min(3, len(lines))
        gone = set()
        for i in range(len(lines) - n + 1):
            run = tuple(x.strip(" ") for x in lines[i : i + n])
            if any(run):
                if run in seen:
                    gone |= set(range(i, i + n))
                seen.add(run)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip(" "):
            out[d] = text
    return out


def replay_decontaminated(docs, items):
    windows = set()
    for t in items:
        w = re.findall(ALNUM, low(t))
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1 if w else 0)}
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs.items():
        w = re.findall(ALNUM, low(t))
        if not any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1)):
            out[d] = t
    return out


def replay_packed(docs):
    """Whole sequences first, then remainders, longest first, each in the first bin with room."""
    encoder = Encoder(vocabulary(), 1).whole
    ids = {d: np.array(encoder.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in docs.items()}
    sequences, rest = [], []
    for d in sorted(docs):
        n, at = len(ids[d]), 0
        while n - at >= 2048:
            sequences.append([(d, at, 2048)])
            at += 2048
        if n > at:
            rest.append((d, at, n - at))
    bins = []
    for piece in sorted(rest, key=lambda x: -x[2]):
        for b in bins:
            if sum(x[2] for x in b) + piece[2] <= 2048:
                b.append(piece)
                break
        else:
            bins.append([piece])
    rows = set()
    for s, pieces in enumerate(sequences + bins):
        at = 0
        for d, start, n in pieces:
            rows.add((d, start, n, zlib.crc32(ids[d][start : start + n].tobytes()), len(ids[d]), s, at))
            at += n
    return rows


def test_replay(spark, tmp_path):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(words[:60])
    extra = {
        9001: " ".join(words[:200]),
        9002: " ".join([*words[:100], "other", *words[101:200]]),  # a near copy
        9003: f"{' '.join(words[200:280])}\n{passage}\nmore of it here\nand a last line of it",
        9004: f"{' '.join(words[220:300])} x\n{passage}\nmore of it here\nand a last line of it",  # a later run of three lines
        9005: "short",
        9006: "one two three " * 80,  # repetition
        9007: "tail " + spark.read.parquet(f"{DATA}/benchmark.parquet").first().text + " " + " ".join(f"v{i}" for i in range(60)),
    }
    base = tmp_path / "sf"
    rows = [tuple(r) for r in docs.values()] + [(d, t, "en", "extra", len(t)) for d, t in extra.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(base / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(base / "benchmark.parquet"))

    kept = {r[0]: r[1] for r in rows if brute_verdict(r[1] or "")[1]}
    after_quality = set(kept)
    kept = replay_lines(kept)
    component = brute_near(list(kept.items()))
    kept = {d: t for d, t in kept.items() if component[d] == d}
    kept = replay_decontaminated(kept, [r.text or "" for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert {9001, 9003} <= set(kept) and not {9002, 9005, 9006, 9007} & set(kept) and {9007} <= after_quality
    got = {tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")) for r in p.run(spark, str(base)).collect()}
    assert got == replay_packed(kept)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(p.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert sorted(out.columns) == sorted(columns) and 0 < out.count() <= n
        assert out.where("n_chars <> char_length(text)").count() == 0
        docs, n = out, out.count()


def test_stages_on_odd_rows(spark):
    rows = [(None, "null id " * 40, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c " * 30, "en", "s", 1), (2, "a b c " * 30, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = defaultdict(list)
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        got[name] = sorted((r.doc_id for r in stage(spark, docs, DATA).collect()), key=str)
    assert got["quality rules"] == [] and got["line dedup"] == [1, 1, 2, None] and got["near-duplicates"] == [1, 1, 2, 2, None]
    assert got["decontamination"] == [1, 1, 2, 2, None] and set(got["packing"]) == {1, 2, None}
