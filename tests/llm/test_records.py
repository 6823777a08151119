"""Conversations, fill-in-middle documents and WARC archives against plain Python."""

import gzip
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import alignment, conversations, fill_middle, warc
from riskloom.sources import shared_files

NEXT = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (3, "a"): 2}


def cheapest(codes, cut, gone):
    """(cost, audit) by a search over whole audits, cheapest and least first."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(codes) and state in (0, 2):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for k, symbol in enumerate("uas"):
            after = NEXT.get((state, symbol))
            if after is None:
                continue
            if symbol != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, after))
            if i < len(codes) and not gone[i]:
                if codes[i] == k:
                    heapq.heappush(heap, (cost + cut[i], audit + "K", i + 1, after))
                elif symbol != "s":
                    heapq.heappush(heap, (cost + cut[i] + 2, audit + "R", i + 1, after))
        if i < len(codes):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
    raise AssertionError


def test_alignment_finds_the_least_cheapest_audit():
    draws = random.Random(1)
    for _ in range(1500):
        n = draws.randint(1, 9)
        codes = draws.choices(range(4), draws.choice([(4, 4, 1, 1), (1, 1, 4, 1), (1, 5, 1, 3)]), k=n)
        cut, gone = [int(draws.random() < 0.3) for _ in codes], [draws.random() < 0.15 for _ in codes]
        want = cheapest(codes, cut, gone)
        assert alignment.align(codes, cut, gone) == want
        step = draws.randint(1, 4)
        ways = [alignment.stretches(alignment.Turns.of(codes[i:i + step], cut[i:i + step], gone[i:i + step]), i == 0, i + step >= n)
                for i in range(0, n, step)]
        cost, places = alignment.chain(ways)
        assert (cost, "".join(w[p][3] for w, p in zip(ways, places))) == want


def plain_repair(rows):
    """The contract's result of the repaired rows, in plain Python."""
    out = {}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(case, text)
        for _ in range({0: 0, 3: 2}.get(case, 1)):
            groups[conv].append((turn is not None, turn or 0, "user" if case == 4 else role, text))
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        known = [t[1] for t in turns if t[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        faults, seen = [], set()
        for _, _, role, text in turns:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        codes = ["uas".find(i) % 4 if i else 3 for i in initials]
        cost, audit = cheapest(codes, [int(f == "truncated") for f in faults], [f in ("blank", "duplicate") for f in faults])
        fixed, at = [], 0
        for edit in audit:
            system = not fixed and edit == "K" and initials[at] == "s"
            want = "user" if sum(not f.startswith("s") for f in fixed) % 2 == 0 else "assistant"
            if edit == "I":
                fixed.append(f"{want}:")
                continue
            if edit != "D":
                fixed.append(f"{turns[at][2] if edit == 'K' or system else want}:{turns[at][3]}")
            at += 1
        digest = hashlib.sha256("\n".join(fixed).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def odd_turns():
    draws = random.Random(5)
    texts = ["Hi there.", "well", " ", "", None, "Ünder!", "a\nb?", "yes. \n", "\x0b\x0c"]
    roles = ["user", "assistant", "system", "", None, "User", "Sys", "tool", "support"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draws.randint(1, 12)):
            legal = ["user", "assistant"][turn % 2]
            rows.append((conv, draws.choice([turn, turn, turn, turn + 3, None, -turn]),
                         draws.choice([legal] * 6 + roles), draws.choice([f"Line {turn}."] * 4 + texts)))
    rows += rows[:9]
    rows += [(70, None, "user", "a."), (70, None, "assistant", "b."), (71, None, None, None)]
    return rows


@pytest.mark.parametrize("long, slot", [(1000, 250_000), (3, 250_000), (4, 5)])
def test_conversation_repair(spark, tmp_path, monkeypatch, long, slot):
    rows = odd_turns()
    schema = "conv_id long, turn long, role string, text string, part long, cost string, audit int"
    spark.createDataFrame([(*r, 1, "c", None) for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(conversations, "LONG", long)
    monkeypatch.setattr(conversations, "SLOT_ROWS", slot)
    got = conversations.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r[0]: tuple(r)[1:] for r in got} == plain_repair(rows)
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0


def plain_cut(doc_id, text, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or re.search("<[PSM]>", text):
        return doc_id, len(lines), "plain", None, None, text
    spm = h[3] % 100 < 50
    return (doc_id, len(lines), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(fill_middle, "SEND", 100)
    monkeypatch.setattr(fill_middle, "CHUNK", 7)
    draws = random.Random(2)
    more = [(100 + i, "".join(draws.choice(["a", "é", "日", "𝄞", "\n", "<", "P>", "<S", "\r"]) for _ in range(draws.randint(0, 400))))
            for i in range(60)]
    more += [(200, "x<P>y\n"), (201, "a\n<M>"), (202, "\n\n\n"), (203, "<"), (204, "S>\n<"), (204, "S>\n<"), (None, "a\nb\nc")]
    docs = odd_docs.select("doc_id", "text", "n", "size").unionByName(
        spark.createDataFrame([(*r, None, 1) for r in more], "doc_id long, text string, n string, size long"))
    rows = [*odd_rows, *more]
    for error in (0, 1, 64):
        cut = fill_middle.transform(docs, error=error).withColumn("again", fill_middle.restored())
        got = cut.collect()
        assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter(
            plain_cut(i, t) for i, t in rows)
        assert Counter((r["doc_id"], r["again"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.transform(no_docs).count() == 0
    assert {r["form"] for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}


def test_rank_index_is_exact_and_bounded():
    draws = np.random.default_rng(0)
    for n, error in ((0, 64), (1, 64), (2, 0), (70, 5), (9000, 64), (50_000, 300)):
        offsets = np.concatenate([[0], np.cumsum(draws.integers(1, draws.integers(2, 2000), n))]).astype(np.int64)
        index = fill_middle.fit(offsets, error)
        ranks = np.arange(n + 1)
        assert (index.offset(ranks) == offsets).all()
        assert np.abs(index.predict(ranks) - offsets).max() <= error + 1
    line = np.arange(100_000) * 80
    assert len(fill_middle.fit(line).first) == 1


def pages(spark, rows):
    return spark.createDataFrame([(*r, 5, "v") for r in rows], "page_id long, url string, html string, refers_to int, valid string")


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 11)
    body, other = "<p>é" * 40, "x" * 99
    rows = [(3, "http://a/é b", body), (1, "http://a", body), (2, None, body), (9, "u\r\nX: 1", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (4, "", None), (5, "e", ""),
            (6, "h", other), (7, "h", other), (8, "l", "long " * 40_000), (1, "again", body), (None, "n", body), (None, None, None)]
    manifest = warc.write_archives(pages(spark, rows), f"{tmp_path}/archives", archive_bytes=400)
    got = warc.read_archives(manifest).collect()
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        refers = 1 if html == body and page_id != 1 else None
        want.append((page_id, "revisit" if refers else "response", refers, len(raw), hashlib.sha256(raw).hexdigest(), True, None if refers else html or ""))
    assert Counter(tuple(r)[:1] + tuple(r)[2:] for r in got) == Counter(want)
    assert {r["url"] for r in got if r["page_id"] in (3, 9)} == {"http://a/%C3%A9%20b", "u%0D%0AX:%201"}
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 1
    assert warc.read_archives(warc.write_archives(pages(spark, []), f"{tmp_path}/none")).count() == 0


def test_damaged_archives(spark, tmp_path):
    def read(name, *records):
        with shared_files.create(f"file:{tmp_path}/{name}") as out:
            for record in records:
                out.write(gzip.compress(record) if isinstance(record, bytes) else b"".join(record))
        return warc.read_archives(spark.createDataFrame([(f"file:{tmp_path}/{name}",)], "path string")).collect()

    html = b"text " * 30
    good = b"".join(warc.record(1, "u", html, hashlib.sha256(html).hexdigest(), None))
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    lost = b"".join(warc.record(2, "u", html, hashlib.sha256(html).hexdigest(), 7))
    later = b"".join(warc.record(3, "u", html, hashlib.sha256(html).hexdigest(), 1))
    assert [(r["page_id"], r["valid"]) for r in sorted(read("mixed", info, good, lost, later))] == [(1, True), (2, False), (3, True)]
    assert [r["valid"] for r in read("changed", good.replace(b"text text", b"tExt text", 1))] == [False]
    for name, wrong in (("short", good.replace(b"Content-Length: 2", b"Content-Length: 3", 1)), ("tail", good + b"x"), ("none", b"no record\r\n\r\n")):
        with pytest.raises(Exception, match="record"):
            read(name, wrong)
    with pytest.raises(Exception, match="ends inside"):
        read("cut", [gzip.compress(good)[:-9]])
