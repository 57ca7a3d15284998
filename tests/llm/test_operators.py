"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import bpe, chat, decontam, pii, quality, secrets, simhash, tokenfiles, topk, urlfilter
from tabloom.llm.common import connected_components

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, hits int, score int, k1 int, words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], DOCS)


def folder(tmp_path, name):
    return f"file://{tmp_path}/{name}"


def test_components_match_union_find(spark):
    random.seed(3)
    pairs = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_url_verdicts(spark):
    rows = [(1, "http://www.a.example.org/es/x"), (2, "https://b.com/de/1"), (3, None), (4, "no address"), (5, "http://shop.net/in?x"), (5, "http://shop.net/in?x"), (None, "HTTP://B.COM"), (6, "http://c.net/p.html"), (7, "http://m.c.net/p/"), (8, "http://ok.org/q")]
    html = {5: '<LINK rel="canonical" href="https://b.com/de/1">', 7: "<meta http-equiv=refresh content='0; url=http://ok.org/q'>"}
    pages = spark.createDataFrame([(i, u, html.get(i), "h") for i, u in rows], "page_id long, url string, html string, node string")
    got = sorted(map(tuple, urlfilter.judge(pages, urlfilter.rules_table(spark, urlfilter.RULES)).collect()), key=str)
    assert got == sorted(
        [(1, "www.a.example.org", "/es/x", "example.org/es/", "block"), (2, "b.com", "/de/1", "com/de/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (None, "b.com", "", None, "allow"), (8, "ok.org", "/q", "org/", "allow")]
        + [(5, "shop.net", "/in", None, "block")] * 2 + [(6, "c.net", "/p.html", None, "allow"), (7, "m.c.net", "/p/", None, "allow")],
        key=str,
    )
    blocked = urlfilter.judge(spark.createDataFrame([(1, "http://x.net/1"), (2, "http://x.net/2")], "page_id long, url string"), urlfilter.rules_table(spark, [("block", "x.net", "/1"), ("allow", "y.net", "/")]), spark.createDataFrame([("http://x.net/2", "http://x.net/1")], "source string, target string"), html_col=None)
    assert {r.page_id: r.verdict for r in blocked.collect()} == {1: "block", 2: "block"}
    kept = urlfilter.judge(spark.createDataFrame([(1, "http://x.net/1"), (2, "http://x.net/2")], "page_id long, url string"), urlfilter.rules_table(spark, [("block", "x.net", "/1"), ("allow", "y.net", "/")]), spark.createDataFrame([("http://x.net/2", "http://x.net/1"), ("http://y.net/", "http://x.net/2")], "source string, target string"), html_col=None)
    assert {r.page_id: r.verdict for r in kept.collect()} == {1: "block", 2: "allow"}
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_table(spark, urlfilter.RULES)).count() == 0


def test_linked_secrets(spark):
    weak, key = "client_id: shop-77", "Zx9" * 8
    rows = [(1, f"{weak} then {key} at https://api.host.io/v1"), (2, f"{weak} alone"), (3, f"{key} beside https://api.host.io"), (4, f"{weak}\n\n{key}"), (5, weak + " " * 3000 + key), (6, None), (7, ""), (None, "password=hunter22 AKIA" + "Q" * 16), (8, "é" * 5 + " Token: 'abcdef' " + "0a" * 12)]
    rows += [(9, f"{weak} at https://api.host.io"), (10, "see https://a.io/some-long-path/2024 and https://b.io/other-long-path/2025")]
    found = secrets.find(docs(spark, rows + rows[:1])).collect()
    got = {r.doc_id: {(s["kind"], s["start"], s["end"]) for s in r.spans} for r in found}
    text = rows[0][1]
    at = lambda part: (text.index(part), text.index(part) + len(part))
    assert got[1] == {("weak_id", *at(weak)), ("weak_secret", *at(key)), ("weak_endpoint", *at("https://api.host.io/v1"))}
    assert sum(r.doc_id == 1 for r in found) == 2 and len(found) == len(rows) + 1
    assert got[3] == {("weak_secret", 0, 24), ("weak_endpoint", 32, 51)}
    assert got[5] == {("weak_id", 0, 18), ("weak_secret", 3018, 3042)}
    assert not any(got[k] for k in (2, 4, 6, 7, 9, 10))
    assert got[None] == {("assign", 0, 17), ("access", 18, 38)}
    assert got[8] == {("assign", 6, 20), ("hex", 22, 46)}
    assert secrets.find(docs(spark, rows).limit(0)).count() == 0


def _secrets_by_pairs(text):
    """All spans of a text: plain scans, then every pair of parts of a scope."""
    name = "(?i:password|passwd|secret|token|api_?key)"
    base = [("assign", m) for m in re.finditer(name + """["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    base += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = [(*m.span(), kind) for kind, m in base]
    weak = [(*m.span(), k.name) for k in secrets.WEAK for m in re.finditer(k.pattern, text) if k.name != "weak_secret" or (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))]
    meet = lambda a, b: a[0] < b[1] and b[0] < a[1]
    weak = [w for w in weak if not any(meet(w, b) for b in base) and not (w[2] == "weak_secret" and any(meet(w, e) for e in weak if e[2] == "weak_endpoint"))]
    cuts = [m.end() for m in re.finditer(r"\n[ \t\r]*\n\s*", text)]
    scope = lambda s: sum(c <= s[0] for c in cuts)
    side = lambda s: "id" if s[2] in ("weak_id", "access") else "end" if s[2] == "weak_endpoint" else "secret"
    pairs = {("id", "secret"), ("secret", "id"), ("secret", "end"), ("end", "secret")}
    kept = [w for w in weak if any((side(w), side(o)) in pairs and scope(w) == scope(o) and not meet(w, o) for o in base + weak)]
    return base, kept


def test_linked_secrets_equal_every_pair_and_the_query_its_digests(spark, tmp_path):
    random.seed(11)
    atoms = ["client_id=shop-77", "user_name: bob.b", "AKIA" + "Q7" * 9, "AKIA" + "Q7" * 3, "Zx9" * 8, "0a" * 13, "https://api.host.io/v1?x=abc123abc123abc1", "password = hunter22", "api_key:'abc'", "\n\n", "\n \n", "é plain words", "\n", "Token=" + "z" * 7, "x" * 900]
    texts = ["".join(a + random.choice([" ", "", " ; "]) for a in random.choices(atoms, k=random.randrange(12))) for _ in range(250)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(300, None), (301, ""), (None, texts[7]), (3, texts[3]), (302, ("client_id=shop-77 " + "w " * 40_000 + "Zx9" * 8))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in secrets.op2_linked_secrets(spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()), key=str)
    want = []
    line = lambda s, order: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(s, key=lambda x: (x[0], order.index(x[2]), x[1])))
    for doc_id, text in rows:
        base, kept = _secrets_by_pairs(text or "")
        counts = [sum(s[2] == k for s in base) for k in secrets.BASE]
        want.append((doc_id, *counts, hashlib.sha256(line(base, secrets.BASE).encode()).hexdigest(), line(base + kept, secrets.ORDER)))
    assert got == sorted(want, key=str)
    assert any("weak_endpoint" in w[5] for w in want)


def test_pii_spans_and_revealing_terms(spark):
    secret = "mallory@corp.example.com"
    rows = [(k, f"note {k} says zanzibar {secret} today") for k in range(6)] + [(10 + k, f"plain {'note' if k % 2 else 'says'} text today number {k}") for k in range(60)]
    rows += [(90, None), (91, ""), (None, "a@b.c 256.1.1.1 10.0.0.255 card 4111 1111 1111 1111 +49 (0) 170 1234567 x"), (92, "a" * 50_000)]
    found = pii.find(docs(spark, rows + rows[:1]))
    got = {r.doc_id: sorted((s["start"], s["end"], s["kind"]) for s in r.spans) for r in found.collect()}
    assert found.count() == len(rows) + 1
    word = rows[0][1].index("zanzibar")
    assert got[0] == [(word, word + 8, "remove"), (word + 9, word + 9 + len(secret), "email")]
    assert got[10] == got[90] == got[91] == got[92] == []
    assert [k for _, _, k in got[None]] == ["email", "ip", "card", "phone"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert clean[0] == "note 0 says  [EMAIL] today" and clean[10] == rows[6][1] and clean[90] is None
    assert pii.sanitise(docs(spark, rows).limit(0)).count() == 0


def test_pii_support_is_counted_exactly(spark):
    name = lambda k: "word" + "".join(chr(97 + int(d)) for d in str(k))
    rows = [(3 * k + i, f"{'abc'[i] * 2} {k} {name(k)} u{k}@h.example {i}") for k in range(900) for i in range(3)]
    found = pii.find(docs(spark, rows)).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == "remove")).alias("n"))
    assert found.where("n <> 1").count() == 0


def test_pii_words_are_judged_over_whole_texts(spark):
    far = " ".join(["text today number"] * 20)
    rows = [(k, f"zanzibar {k} {far} 12 {secret}, 77 {far} Zanzibar {k}") for k, secret in enumerate(["mallory@corp.example.com"] * 4)]
    rows += [(10 + k, f"plain text today number {k}") for k in range(60)]
    found = {r.doc_id: sorted((s["start"], s["kind"]) for s in r.spans) for r in pii.find(docs(spark, rows)).collect()}
    text = rows[0][1]
    assert found[0] == [(0, "remove"), (text.index("mallory"), "email"), (text.index("Zanzibar"), "remove")]
    assert not any(found[10 + k] for k in range(60))


def test_quality_learns_and_covers_whole_texts(spark):
    random.seed(5)
    good = [" ".join(random.choice(["the", "river", "runs", "past", "old", "mills", "and", "stone"]) for _ in range(random.randrange(5, 200))) for _ in range(300)]
    bad = [" | ".join(random.choice(["BUY", "NOW", "$$$", "CHEAP"]) for _ in range(random.randrange(20, 200))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate([*good, *bad])]
    labels = spark.createDataFrame([(k, int(k < 300)) for k, _ in rows] + [(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    net = quality.train(docs(spark, rows), labels)
    scored = {r.doc_id: r.score for r in quality.score(docs(spark, [*rows, (900, None), (901, ""), (None, good[0]), (902, "x" * 300_000)]), net).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(scored[k] >= quality.CUT) == (k < 300) for k in held]) > 0.97
    assert all(0 <= s <= 1 for s in scored.values()) and scored[900] == scored[901]
    assert b"".join(bytes(c[: quality.STEP]) for c in quality.chunks(b"ab" * 5000)).rstrip(b"\0") == b"ab" * 5000
    none = quality.train(docs(spark, rows), labels.limit(0))
    assert {r.score for r in quality.score(docs(spark, rows[:2]), none).collect()} == {1.0}


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.Encoder(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    random.seed(9)
    alphabet = "abcdethion \n\t\xa0été漢字🙂!?<|>0159'"
    rows = [(k, "".join(random.choice(alphabet) for _ in range(random.randrange(0, 400)))) for k in range(60)]
    rows += [(100, None), (101, ""), (None, "null id"), (102, "ab" * 40_000), (103, "   \n\n  x  "), (0, rows[0][1])]
    got = bpe.decode(bpe.encode(docs(spark, rows), path, P.PATTERN), path).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in got) == want
    for text in ("".join(random.choice(alphabet) for _ in range(900)) for _ in range(30)):
        assert encoder._encode_long(text.encode()) == encoder._encode_short(text.encode())


def test_rank_queue_is_a_priority_queue():
    random.seed(2)
    queue, entries = bpe.RankQueue(50_000), [(random.randrange(50_000) // 7, random.randrange(1000)) for _ in range(3000)]
    for rank, position in entries:
        queue.push(rank, position)
    out = []
    while (entry := queue.pop()) is not None:
        out.append(entry)
    assert out == sorted(entries)


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(k * 3, f"text number {k} with   spaces\n\nand words" * (k % 5)) for k in range(50)] + [(7, None), (8, "<|endoftext|> inside"), (9, "long " * 20_000), (3, "repeated id")]
    where = folder(tmp_path, "tokens")
    tokenfiles.write(docs(spark, rows), where, path, P.PATTERN)
    got = sorted(map(tuple, tokenfiles.read_positions(spark, where).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(i for i, _ in rows) and got[0][1] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    want = {(i, tokenfiles.checksum(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0]))) for i, t in rows}
    assert {(r[0], r[3]) for r in got} == want
    assert {r.doc_id for r in tokenfiles.read(spark, where, [9, 150, 8]).collect()} == {8, 9}
    tokenfiles.write(docs(spark, rows).limit(0), folder(tmp_path, "none"), path, P.PATTERN)
    assert tokenfiles.read_positions(spark, folder(tmp_path, "none")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.3, (400, 12)).round(1)
    rows = [(k, [float(x) for x in v], "l") for k, v in enumerate(vectors)]
    rows += [(0, [float(x) for x in vectors[0]], "l"), (50, [9.0] * 12, ""), (51, [8.0] * 12, ""), (51, [-8.0] * 12, ""), (401, [3.0, -2.0], ""), (450, [1.0], ""), (402, [], "")]
    held = [(i, np.floor(256 * np.array(v + [0.0] * (12 - len(v)))).astype(int)) for i, v, _ in rows]
    rows += [(500, None, ""), (501, [1.0, None], ""), (502, [float("nan")] * 12, ""), (503, [float("inf")] * 12, ""), (None, [1.0] * 12, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    want = []
    for at, (q, v) in enumerate(held):
        if q % 50 == 0:
            others = sorted((-int(w @ v), i) for n, (i, w) in enumerate(held) if n != at)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(others[:5])]
    assert sorted(map(tuple, topk.top_k(table, "vec_id % 50 = 0").collect())) == sorted(want)
    assert topk.top_k(table.limit(0), "true").count() == 0
    assert topk.top_k(table.where("vec_id in (1, 2)"), "true").count() == 2


def test_block_search_never_loses_a_member():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-90, 90, (3000, 16)) + 200 * rng.integers(0, 2, (3000, 1)) * rng.integers(-1, 2, (3000, 16))
    block = topk.Block(np.arange(3000), vectors)
    for q in range(0, 3000, 151):
        scores = vectors @ vectors[q]
        places, found = block.search(vectors[q], 5, None, q)
        best = [k for k in np.lexsort((np.arange(3000), -scores)) if k != q][:5]
        assert set(best) <= set(places.tolist()) and (scores[places] == found).all()


def _simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    random.seed(6)
    vocabulary = [f"w{k}É" for k in range(400)]
    rows = []
    for k in range(40):
        words = [random.choice(vocabulary) for _ in range(random.choice([1, 3, 60, 300]))]
        rows.append((1000 - k, " ".join(words)))
        for c in range(random.choice([0, 0, 2, 30])):
            words[random.randrange(len(words))] = f"new{c}"
            rows.append((2000 + len(rows), "\n".join(words)))
    rows += [(5, None), (6, ""), (7, " \t\n"), (1000, rows[0][1]), (None, rows[0][1])]
    prints = [_simhash(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    small = {x: min(rows[k][0] for k in range(len(rows)) if label[k] == x and rows[k][0] is not None) for x in set(label)}
    want = sorted((str(i), prints[k], small[label[k]]) for k, (i, _) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert got == want
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_large_cells_lose_no_component(spark):
    random.seed(1)
    base = random.getrandbits(63)
    prints = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a)} | {random.getrandbits(63) for _ in range(300)}
    roots = connected_components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()
    members = {r.node for r in roots if r.root == min(p for p in prints if (p ^ base).bit_count() <= 2)}
    assert {p for p in prints if (p ^ base).bit_count() <= 2} <= members


def test_chat_round_trip(spark, tmp_path):
    said = [(1, 0, "user", "a\\b ### </turn> ####"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "assistant", None), (2, 0, None, "no role:\n#"), (2, None, "a:\n<x", ""), (None, 5, "assistant", "null conversation"), (3, 700, "assistant", "late 🙂"), (3, 2, "user", "early"), (3, 2, "user", "early")]
    turns = spark.createDataFrame([(*r, "s") for r in said], "conv_id long, turn long, role string, text string, segment string")
    where = folder(tmp_path, "chat")
    chat.write(turns, where)
    key = lambda r: (r[0] or 0, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")
    want = [(c, r or "", t or "") for c, _, r, t in sorted(said, key=key)]
    got = chat.read_turns(spark, where).collect()
    assert [(r.conv_id, r.role, r.text) for r in sorted(got, key=lambda r: (r.conv_id or 0, r.place))] == want
    losses = sorted(((r.conv_id, r.text) for r in chat.read_losses(spark, where).collect()), key=str)
    assert losses == sorted(((c, t or "") for c, _, r, t in said if r == "assistant"), key=str)
    full = {(r.conv_id, r.place): (r.context, r.reply) for r in chat.texts(spark, where).collect()}
    stored = sorted((r for r in spark.read.parquet(f"{where}/segments").collect() if r.conv_id == 1), key=lambda r: r.place)
    whole = "".join(r.segment for r in stored)
    assert full[1, 2][0] == whole[: stored[1].reply_start] and full[1, 2][1] == whole[stored[1].reply_start : stored[1].reply_end]
    assert whole.count("</turn>") == 3 and whole.count("###") == 3
    chat.write(turns.limit(0), folder(tmp_path, "none"))
    assert chat.read_losses(spark, folder(tmp_path, "none")).count() == 0


def _closest(item, text):
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    random.seed(11)
    letters = "abcde "
    items = [(k, "".join(random.choice(letters) for _ in range(random.choice([5, 40, 90])))) for k in range(12)]
    rows = []
    for k in range(60):
        item = list(random.choice(items)[1])
        for _ in range(random.randrange(0, 10)):
            at = random.randrange(len(item))
            item[at : at + random.randrange(2)] = random.choice(["", "x", "yz", random.choice(letters)])
        rows.append((k, "".join(random.choice(letters) for _ in range(50)) + "".join(item).upper() + "\n q " * random.randrange(3)))
    rows += [(90, None), (91, ""), (None, items[0][1]), (0, rows[0][1])]
    bench = spark.createDataFrame([*items, items[0], (77, None), (78, "  ")], "item_id long, text string")
    got = sorted((str(r.doc_id), h["item_id"], h["distance"]) for r in decontam.mark(docs(spark, rows), bench).collect() for h in r.hits)
    want = []
    for i, t in rows:
        for k, item in items:
            item = decontam.normal(item)
            budget = min(int(decontam.RATE * len(item)) + 1, len(item)) - 1
            d = _closest(item, decontam.normal(t))
            if d <= budget:
                want.append((str(i), k, d))
    assert got == sorted(want) and len(want) > 20
    assert decontam.mark(docs(spark, rows), bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_digest_columns(spark):
    assert bpe.digests(docs(spark, [(1, "hello")]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).first().decoded_sha256 == hashlib.sha256(b"hello").hexdigest()
