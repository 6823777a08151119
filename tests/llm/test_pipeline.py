"""The whole pipeline, row by row, against plain Python over documents with planted cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import packing
from tests.llm.test_dedup import brute_links

SMALL = "/root/testdata/sf0.001"


def planted(docs):
    """(doc_id, text) with an exact and a near copy, a passage that two documents share, and a benchmark window."""
    rows = [(d, t) for d, t in docs if t and len(t.split()) > 120][:60]
    texts, item = [t for _, t in rows], " ".join(f"item{i} question" for i in range(9))
    passage = " ".join(texts[5].split()[20:90])
    half = [t[:len(t) // 2] for t in texts]
    plant = [texts[0], texts[1] + " indeed", half[2] + "\n" + passage, "\n".join((half[3], item, half[4])),
             None, "", " \n ", "1234 567", texts[6] + " é " + texts[7]]
    return rows + [(10_000 + i, t) for i, t in enumerate(plant)], item


def brute_cut(rows, window):
    """Texts without the characters of which every byte lies in a repeated window."""
    times, out = Counter(), []
    for _, text in rows:
        raw = text.encode()
        times.update(raw[i:i + window] for i in range(len(raw) - window + 1))
    for doc, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if times[raw[i:i + window]] > 1:
                gone[i:i + window] = True
        at, kept = 0, []
        for c in text:
            size = len(c.encode())
            if not gone[at:at + size].all():
                kept.append(c)
            at += size
        out.append((doc, "".join(kept)))
    return out


def brute_windows(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def brute_pieces(rows):
    tool, out = Tokenizer.from_file(packing.vocabulary_path()), []
    for doc, text in rows:
        ids = [*tool.encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            out.append((doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_rows_of_the_whole_pipeline(spark, tmp_path):
    source = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    lang = {r["doc_id"]: r["lang"] for r in source}
    rows, item = planted([(r["doc_id"], r["text"]) for r in source])
    pq.write_table(pa.table({
        "doc_id": [d for d, _ in rows], "text": pa.array([t for _, t in rows], pa.string()),
        "lang": pa.array([lang.get(d) for d, _ in rows], pa.string()), "source": ["s"] * len(rows),
        "n_chars": pa.array([len(t or "") for _, t in rows], pa.int64())}), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": [1, 2, 3], "text": [item, None, ""]}), f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]

    kept = [(d, t) for d, t in rows if re.search(r"[^\W\d_]", t or "")]
    assert len(kept) == len(rows) - 4
    stand = {r[0] for r in brute_links(kept) if r[4]}
    kept = [r for r in kept if r[0] in stand]
    assert not stand & {10_000, 10_001}
    cut = brute_cut(kept, 200)
    assert sum(a != b for a, b in zip(kept, cut)) >= 4
    items = brute_windows(item)
    clean = [(d, t) for d, t in cut if not brute_windows(t) & items]
    assert {d for d, _ in cut} - {d for d, _ in clean} == {10_003}
    assert sorted(r[:5] for r in got) == brute_pieces(clean)

    placed = {}
    for _, _, _, length, _, sequence, offset in got:
        placed.setdefault(sequence, []).append((offset, length))
    for parts in placed.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
