"""Conversation repair, vector best-fit packing and the filter audit against brute force."""

import hashlib
import heapq
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import bestfit, dialogue, filteraudit, queries, tokens

STATE_OF = {0: "su", 1: "u", 2: "a", 3: "u"}


def least_edits(rows):
    """(cost, audit) of rows (initial, has to go, truncated) by a search over all edits in order of cost, then audit."""
    todo, seen = [(0, "", 0, 0)], set()
    while todo:
        cost, audit, n, state = heapq.heappop(todo)
        if (n, state) in seen:
            continue
        seen.add((n, state))
        if n == len(rows) and state in (0, 3):
            return cost, audit
        for role in "ua":
            if role in STATE_OF[state]:
                heapq.heappush(todo, (cost + 5, audit + "I", n, {"u": 2, "a": 3}[role]))
        if n < len(rows):
            initial, gone, cut = rows[n]
            heapq.heappush(todo, (cost + 2, audit + "D", n + 1, state))
            if not gone:
                for role in STATE_OF[state]:
                    then = {"s": 1, "u": 2, "a": 3}[role]
                    if role == initial:
                        heapq.heappush(todo, (cost + 5 * cut, audit + "K", n + 1, then))
                    if role != "s":
                        heapq.heappush(todo, (cost + 1 + 5 * cut, audit + "R", n + 1, then))


def whole_table(codes):
    """Every span's cell from every split, as CYK has it."""
    n = len(codes)
    cells = {(i, i + 1): dialogue.leaf(codes[i]) for i in range(n)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            options = [dialogue.join(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            cells[i, i + size] = tuple(min((o[x] for o in options if o[x] is not None), default=None) for x in range(16))
    return cells[0, n]


def _code(row):
    initial, gone, cut = row
    return "x" if gone else (initial if initial in "sua" else "o").upper() if cut else initial if initial in "sua" else "o"


def test_cells_match_a_search_and_the_whole_table():
    rng = random.Random(5)
    for _ in range(600):
        rows = [(rng.choice("suuaaaot"), rng.random() < .2, rng.random() < .3) for _ in range(rng.randint(0, 9))]
        codes = "".join(map(_code, rows))
        cell = dialogue.span(codes) if codes else None
        assert dialogue.cheapest(cell) == least_edits(rows)
        if codes:
            assert cell == whole_table(codes)


def _ws(text):
    return text.strip(" \t\n\x0b\x0c\r")


def report(rows):
    """The contract's row of one conversation, without conv_id; ``rows``: damaged (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = _ws(text)[-1:]
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end not in (".", "!", "?") else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = least_edits([(r[1][:1], f in ("b", "d") and f != "", f == "t") for r, f in zip(rows, faults, strict=True)])
    out, n, state = [], 0, 0
    for e in audit:
        wanted = "assistant" if state == 2 else "user"
        role, text = (wanted, "") if e == "I" else (rows[n][1] if e == "K" else wanted, rows[n][2])
        n += e != "I"
        if e != "D":
            out.append(f"{role}:{text}")
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def _conversations(rng, n):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, "", "Umlaut", "unknown", "ä"]
    texts = ["Hi.", "hello", "", " \t\n", "ok!\n", "why? ", "é ", None, "a.b", "漢字。", "x" * 300 + "."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [*range(30), None, -5] for _ in range(rng.randint(1, n))]
    return rows + rows[:4]


@pytest.mark.parametrize("segment", [3, 4096])
def test_repair_of_odd_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    monkeypatch.setattr(dialogue, "FAN_IN", 2)
    rows = _conversations(random.Random(segment), 14)
    rows += [(99, t, "user" if t % 3 else "assistant", f"turn {t % 50}{'.' if t % 7 else ''}") for t in range(150)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, ck string")
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in queries.repair_report(df).collect()}
    hurt = damage(rows)
    want = {c: report([r[1:] for r in hurt if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    assert queries.repair_report(df.where("false")).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Why?"), (1, 2, "user", "  "), (2, 0, "system", "S."), (3, 0, "user", "cut")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    _, found, fixed = dialogue.repair(df)
    assert {r["ck"]: (r["cost"], r["audit"]) for r in found.collect()} == {"c1": (4, "RRD"), "c2": (2, "D"), "c3": (2, "D")}
    assert [(r["place"], r["turn"], r["role"], r["text"], r["edit"]) for r in sorted(fixed.collect(), key=lambda r: r["place"])] == [
        (0, 0, "user", "Hi.", "R"), (1, 1, "assistant", "Why?", "R")]


def _scalar_best_fit(lengths, room):
    bins = []
    for n in lengths:
        at = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if at is None:
            bins.append(room - n)
        else:
            bins[at] -= n
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 100, 700))[::-1]
    for cap in ((100, 100, 10_000), (100, 4, 10_000), (100, 100, 4000), (60, 3, 2000)):
        bins = bestfit.vector_best_fit(lengths, cap, rule)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert len(own) == 1 or (own.sum() <= cap[0] and len(own) <= cap[1] and (own ** 2).sum() <= cap[2])
        assert set(bins) == set(range(bins.max() + 1))
    bins = bestfit.vector_best_fit(lengths, (100, 100, 10_000), rule)
    assert bins.max() + 1 <= max(-(-lengths.sum() // 100), (lengths > 50).sum()) * 1.03
    if rule == "norm":
        alone = bestfit.vector_best_fit(lengths, (100, 700, 10 ** 9), "norm", (1.0, 0.0, 0.0))
        assert alone.max() + 1 == _scalar_best_fit(lengths.tolist(), 100)
    assert len(bestfit.vector_best_fit(np.empty(0, np.int64))) == 0


def _check_pieces(rows, got, path, tokens_max=2048):
    enc = tokens.Encoder(path)
    end = (0).to_bytes(4, "little")
    want = {}
    for r in rows:
        ids = enc._each([r["text"]])[0] + end if r["text"] else end
        want.setdefault(r["doc_id"], []).append(ids)
    cut = {}
    for doc_id, docs in want.items():
        for ids in docs:
            n = len(ids) // 4
            first = n % tokens_max or min(n, tokens_max)
            at = [0, *range(first, n, tokens_max), n]
            for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                key = (doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                cut[key] = cut.get(key, 0) + 1
    have = {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        have[key] = have.get(key, 0) + 1
    assert have == cut
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= tokens_max
    return len(seqs), sum(k[3] * v for k, v in cut.items())


def test_best_fit_of_documents(spark, docs, odd_docs, no_docs, monkeypatch):
    path = queries.tokenizer_path()
    rows = docs.collect()
    n, total = _check_pieces(rows, bestfit.packed(docs, path, with_ids=False).collect(), path)
    assert n <= -(-total // 2048) * 1.05
    monkeypatch.setattr(bestfit, "GROUP_ITEMS", 5)
    odd = odd_docs.withColumns({c: odd_docs["doc_id"] for c in ("piece", "row", "part", "ids", "sequence_id")})
    got = bestfit.packed(odd, path).collect()
    _check_pieces(odd_docs.collect(), got, path)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert bestfit.packed(no_docs, path).count() == 0


def test_tries_hold_whole_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 9))).encode() for _ in range(400)]
    root = filteraudit.Node(b"")
    for i, t in enumerate(texts):
        node = filteraudit.insert(root, t)
        node.rows = [*(node.rows or []), i]
    found = {text: node.rows for node, text in filteraudit.terminals(root, True)}
    assert found == {t: [i for i, x in enumerate(texts) if x == t] for t in set(texts)}
    assert all(len(node.kids) != 1 or node.rows is not None for node in _nodes(root) if node is not root)


def _nodes(node):
    yield node
    for kid in node.kids.values():
        yield from _nodes(kid)


def audit_rows(docs, labels):
    words = [(d, (d["text"] or "").encode().split()) for d in docs]
    low = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            low[t] = min(low.get(t, d["doc_id"]), d["doc_id"])
    fails = []
    for d, w in words:
        t = d["text"] or ""
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        f |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        f |= {"E"} if d["doc_id"] is not None and d["doc_id"] > low[t] else set()
        own = [x for x in labels if x[0] is not None and x[0] == d["doc_id"]]
        fails.append((d["source"] or "", f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {p for p, *_ in fails}:
        rows = [x for x in fails if x[0] == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            here = rows
            for k, f in enumerate(order):
                lost = [x for x in here if f in x[1]]
                here = [x for x in here if f not in x[1]]
                gone[f] += len(lost)
                out[part, "".join(order), k + 1] = [len(here), len(lost), sum(f in x[1] for x in rows) - len(lost), sum(x[1] == {f} for x in rows),
                                                    sum(x[2] for x in lost), sum(x[3] for x in lost)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(gone[order[k - 1]])
    return out


def _audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
            for r in filteraudit.audit(docs, labels).collect()}


def test_empty_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "TRIE_ROWS", 5)
    monkeypatch.setattr(filteraudit, "TASK_ROWS", 20)
    docs = spark.createDataFrame([(i, None if i % 2 else "", "s") for i in range(200)], "doc_id long, text string, source string")
    dealt = filteraudit.by_prefix(docs)
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sorted((r["doc_id"], r["mask"]) for r in filteraudit.masks(docs).collect()) == [(i, 1 + 16 * (i > 0)) for i in range(200)]


@pytest.mark.parametrize("rows,size", [(20_000, 1 << 25), (2, 1 << 25), (1, 200)])
def test_filter_audit_of_odd_documents(spark, odd_docs, no_docs, monkeypatch, rows, size):
    """Also with tries so small that prefixes are lengthened and frequent texts salted."""
    monkeypatch.setattr(filteraudit, "TRIE_ROWS", rows)
    monkeypatch.setattr(filteraudit, "TRIE_BYTES", size)
    monkeypatch.setattr(filteraudit, "TASK_BYTES", 20_000)
    rng = random.Random(rows)
    base = "the same beginning of many texts and then some more of it " * 6
    more = [(100 + i, base + rng.choice(["", "A", "B", "tail #", "Ä", "\U0001f600"]), "en", rng.choice(["a", "b", None, ""]), 1) for i in range(40)]
    more += [(200 + i, "word " * 80 if i % 2 else "copy " * 3, "en", "a", 1) for i in range(25)] + [(300, "A" * 20, "en", "a", 1)] * 3
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, 1, 1, *range(5, 230, 3)]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clash = docs.withColumns({c: docs["doc_id"] for c in ("part", "mask", "h", "level", "salt", "start", "n", "good", "toxic")})
    assert _audited(clash, table.withColumn("source", table["doc_id"])) == audit_rows(docs.collect(), labels)
    assert filteraudit.audit(no_docs, table).count() == 0
    assert _audited(docs, table.where("false")) == audit_rows(docs.collect(), [])
