"""Secrets, shards, tokens, packing, leaks, quality and toxicity against plain Python, on odd rows."""

import hashlib
import random
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import decontaminate, packing, quality, secrets, sharding, token_counts, toxicity
from tests.llm import plain

NONE_DIGEST = hashlib.sha256(b"").hexdigest()


def test_base_secrets(spark):
    out = secrets.scan_secrets(plain.fixture(spark)).collect()
    rows = plain.texts()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    by = {r.doc_id: r for r in out}
    assert (by[401].n_assign, by[401].base_sha256, by[401].spans) == (0, NONE_DIGEST, "")
    text = dict(rows)[411]
    spans = [("assign", *m.span()) for m in re.finditer(r'password = "abcdefghijkl123', text)]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text)] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]{16,}", text)]
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: s[1]))
    assert by[411].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (by[411].n_assign, by[411].n_access, by[411].n_hex) == (1, 1, 1)


def test_a_failing_match_hides_what_it_covers():
    assert secrets.Scanner().base("password = token: abcdefghijklmnop") == []
    assert secrets.Scanner().base("paſſword = abcdefghijklmnop") == []


def test_entropy_windows_equal_a_recount():
    r = random.Random(2)
    rule = secrets.CLASSES[1]
    groups = [frozenset(g) for g in rule.groups]
    for _ in range(60):
        piece = "".join(r.choice("aA1bB2cC3dD4" if r.random() < 0.3 else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(20, 120)))
        covered = set()
        for i in range(len(piece) - rule.window + 1):
            w = piece[i : i + rule.window]
            bits = -sum(c / len(w) * np.log2(c / len(w)) for c in Counter(w).values())
            if bits >= rule.bits - 1e-9 and all(any(x in g for x in w) for g in groups):
                covered.update(range(i, i + rule.window))
        mine = {k for a, b in secrets.high_windows(piece, rule, groups) for k in range(a, b)}
        assert mine == covered


def test_random_keys_are_found_and_placeholders_are_not():
    scan = secrets.Scanner().entropy
    assert scan("key aB3xK9qLm2Zp7RtYw5VcN8sD1fGh end")
    assert not scan("key exampleAB3xK9qLm2Zp7RtYw5VcN8sD1fGh end")
    assert not scan("averyveryverylongwordwithoutanydigitsinit AVERYLONGWORDWITHOUTDIGITSATALL")


def test_keys_beside_allowed_text_are_found():
    scan = secrets.Scanner().entropy
    key = "aB3xK9qLm2Zp7RtYw5VcN8sD1fGh"
    for text in (f"{key}//{key}", f"/example/config/{key}", f"my_sample_{key}", f"dummy-dummy-{key}"):
        assert any(b == len(text) and a <= len(text) - len(key) for a, _, b in scan(text)), text
    assert not scan(f"https://{key}/{key} and www.{key}")
    assert scan(f"https://host.net?key={key}")
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        r = random.Random(1)
        for _ in range(50):
            one = "".join(r.choices(alphabet, k=40))
            assert scan(f"is {one} here"), one
    assert {secrets.Scanner().kind(k) for _, k, _ in scan("x 04dbebab91ab85687d33eeaaf9ac699e1188f962 y")} == {"entropy_hex"}


def test_long_candidates_take_linear_time():
    r = random.Random(8)
    key = lambda: "".join(r.choices(string.ascii_letters + string.digits, k=30))
    scanner = secrets.Scanner()
    for text in ("-".join(f"sample-{key()}" for _ in range(26_000)), " ".join(f"https://x.org/{key()}" for _ in range(22_000)), "/".join(key() for _ in range(32_000))):
        started = time.time()
        scanner.entropy(text)
        assert len(text) > 900_000 and time.time() - started < 20
    rule, _, groups = scanner._ready[1]
    for _ in range(200):
        piece = "".join(r.choices(string.ascii_letters + string.digits, k=r.randint(24, 120)))
        allowed = [(a, a + r.randint(0, 20)) for a in r.choices(range(-5, len(piece)), k=r.randint(0, 5))]
        free = [(a, b) for a, b in secrets.high_windows(piece, rule, groups)]
        places = {(i, i + rule.window) for a, b in free for i in range(a, b - rule.window + 1) if secrets.high_windows(piece[i : i + rule.window], rule, groups)}
        kept = sorted((a, b) for a, b in places if not any(x < b and a < y for x, y in allowed if x < y))
        assert {i for a, b in secrets.high_windows(piece, rule, groups, allowed) for i in range(a, b)} == {i for a, b in kept for i in range(a, b)}


def test_secrets_of_no_rows(spark):
    nothing = plain.fixture(spark, [])
    assert secrets.scan_secrets(nothing).collect() == [] and secrets.redact_secrets(nothing).collect() == []
    assert token_counts.count_tokens(nothing).collect() == []


def test_secrets_are_masked(spark):
    out = {r.id: r for r in secrets.redact_secrets(plain.fixture(spark)).collect()}
    rows = plain.texts()
    assert len(out) == len(rows)
    for k, (i, text) in enumerate(rows):
        assert out[k].text == text if i != 411 else "[SECRET]" in out[k].text and "AKIA" not in out[k].text
        assert out[k].n_chars == len(out[k].text or "")


def test_shards(spark):
    rows = [r for r in plain.texts() if len(r[1] or "") < 3000] + [(5000 + i, "hot text " * 20) for i in range(400)]
    out = sharding.shard(plain.fixture(spark, rows), shards=7, ranges=64, sample=500).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r)
    assert set(slots) == set(range(7))
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    for mine in slots.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 7) <= largest
    assert sharding.shard(plain.fixture(spark, [])).count() == 0


def test_token_counts(spark):
    model = token_counts.unigram(token_counts.vocabulary())

    def tokens(word):
        word = token_counts.MARK + word
        best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            best[i] = (best[i - 1][0] + model.unknown * size, best[i - 1][1] + size)
            for j in range(i - 1, -1, -1):
                if word[j:i] in model.scores and best[j][0] + model.scores[word[j:i]] > best[i][0]:
                    best[i] = (best[j][0] + model.scores[word[j:i]], best[j][1] + 1)
        return best[-1][1]

    rows = [r for r in plain.texts() if r[0] != 409] + [(600, "日本語 naïve Ω≈ç")]
    out = token_counts.count_tokens(plain.fixture(spark, rows)).collect()
    cache = {}
    expected = [(i, len(w), sum(cache.setdefault(x, None) or cache.update({x: tokens(x)}) or cache[x] for x in w)) for i, t in rows for w in [plain.WORDS(t or "")]]
    assert Counter((r.doc_id, r.n_pretokens, r.n_tokens) for r in out) == Counter(expected)


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = plain.texts() + [(700, "a <|endoftext|> b"), (701, "\x1c\x85　 ½ ²")]
    exact = Tokenizer.from_file(packing.vocabulary())
    expected = Counter((i, tuple([*exact.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    out = packing.pack(plain.fixture(spark, rows)).collect()
    sequences = {}
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = []
    for k in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[k]):
            assert offset == at
            at += length
        used.append(at)
    assert all(u == 1024 for u in used[:-1]) and 0 < used[-1] <= 1024
    stream = [int(x) for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)) for x in np.frombuffer(bytes(r.ids), "<u4")]
    found, at = Counter(), 0
    for r in sorted((r for r in out if r.start == 0), key=lambda r: (r.sequence_id, r.offset)):
        found[(r.doc_id, tuple(stream[at : at + r.doc_tokens]))] += 1
        at += r.doc_tokens
    assert found == expected and at == len(stream)
    assert packing.pack(plain.fixture(spark, [])).count() == 0


def test_leaks(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(900)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = {k: say(r.choice((5, 7, 8, 15, 16, 24, 40, 70, 140))) for k in range(40)}
    rows, expected = [], set()
    for d in range(240):
        k = d % 40
        item = list(items[k])
        for _ in range(int(len(item) * 0.1) if d >= 80 else 0):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice(([], [r.choice(words)], [item[at], r.choice(words)]))
        near = say(r.randint(0, 50)) + item + say(r.randint(0, 50))
        rows.append((d, " ".join(near if d % 2 else [w.upper() for w in near])))
        expected.add((d, k))
    rows += [(1000 + d, " ".join(say(120))) for d in range(40)] + [(2000, None), (2001, ""), (None, "w1 w2")]
    bench = spark.createDataFrame([(k, " ".join(v), "x") for k, v in items.items()] + [(90, None, "x"), (91, "w1 w2", "x"), (0, " ".join(items[0]), "x")], "item_id long, text string, doc string")
    docs = plain.fixture(spark, rows)
    out = decontaminate.find_leaks(docs, bench).collect()
    texts = {d: plain.WORDS((t or "").lower()) for d, t in rows}
    for row in out:
        assert row.distance == plain.edit_distance(items[row.item_id], texts[row.doc_id]) <= 0.2 * row.item_words
    found = {(row.doc_id, row.item_id) for row in out}
    assert {e for e in expected if e[0] < 80} <= found, "exact leaks are always found"
    near = {e for e in expected if e[0] >= 80}
    assert len(near & found) >= 0.9 * len(near)
    assert not {row.doc_id for row in out if row.doc_id is None or row.doc_id >= 1000}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in rows} - {d for d, _ in found}
    assert decontaminate.find_leaks(plain.fixture(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_long_items(spark):
    """An item of 12 000 words, in a document with words around it, and with a tenth of its words edited in another."""
    r = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    item = r.choices(words, k=12_000)
    edited = [r.choice(words) if r.random() < 0.1 else w for w in item]
    docs = plain.fixture(spark, [(1, " ".join(["before"] * 50 + item + ["after"] * 50)), (2, " ".join(edited)), (3, " ".join(r.choices(words, k=20_000)))])
    bench = spark.createDataFrame([(9, " ".join(item), "x"), (9, "other words under the same name", "y"), (None, None, "z")], "item_id long, text string, said string")
    keys = decontaminate.item_keys(bench.select(F.col("item_id").alias("item"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("bigint").alias("said")), 1)
    assert "text" not in keys.columns
    found = decontaminate.find_leaks(docs, bench).collect()
    assert [(e.item_words, e.distance, e.start_word) for e in found if e.doc_id == 1] == [(12_000, 0, 50)]
    assert {e.doc_id for e in found} == {1, 2}


@pytest.mark.parametrize("length", [5, 8, 12, 20, 40, 70, 150, 300])
def test_a_fifth_of_the_words_may_be_edited(spark, length):
    """At the operator's own limit, nine of ten edited passages are found, whatever their length."""
    r = random.Random(length)
    words = [f"w{k}" for k in range(4000)]
    items, docs = [], []
    for i in range(40):
        item = r.choices(words, k=length)
        copy = list(item)
        for _ in range(int(0.2 * length)):
            place = r.randrange(len(copy))
            kind = r.choice(("put", "drop", "change"))
            if kind == "put":
                copy.insert(place, r.choice(words))
            elif kind == "drop" and len(copy) > 2:
                del copy[place]
            else:
                copy[place] = r.choice(words)
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(r.choices(words, k=60) + copy + r.choices(words, k=60))))
    found = {(e.doc_id, e.item_id) for e in decontaminate.find_leaks(plain.fixture(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(found & {(i, i) for i in range(40)}) >= 36


def test_quality(spark):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n))
    clean = [(i, say(r.randint(30, 300))) for i in range(1000, 1900)]
    junk = [(i, " ".join(w + "###$$$" for w in say(80).split())) for i in range(3000, 3010)]
    rows = plain.texts() + clean + junk
    out = quality.quality(plain.fixture(spark, rows)).collect()
    text = {(i, plain.base_statistics(t)) for i, t in rows}
    assert len(out) == len(rows)
    for row in out:
        base = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert (row.doc_id, base) in text
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
        assert not (row.kept and row.base_failed)
    kept = {row.doc_id for row in out if row.kept}
    assert {i for i, _ in clean} <= kept and not {i for i, _ in junk} & kept
    assert quality.quality(plain.fixture(spark, [])).count() == 0


def test_quality_of_small_groups(spark):
    """Sources of 40 to 60 rows: a rare language with longer words stays, and words like the others' are its outliers."""
    r = random.Random(8)
    say = lambda n, low, high: " ".join("".join(r.choices("abcdefgh", k=r.randint(low, high))) for _ in range(n))
    rows = [(i, say(r.randint(30, 300), 2, 8), "en", f"s{i % 12}") for i in range(720)]
    rows += [(1000 + i, say(r.randint(30, 300), 16, 28), "xx", "s0") for i in range(50)]
    rows += [(2000 + i, say(120, 2, 4), "xx", "s0") for i in range(2)]
    out = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = {row.doc_id for row in out if row.kept}
    assert kept == {i for i, *_ in rows if i < 2000}


def test_chi_square():
    assert quality.chi2_quantile(0.75, 5) == pytest.approx(6.62568, abs=1e-4)
    assert quality.chi2_cdf(14.0671, 7) == pytest.approx(0.95, abs=1e-5)


def test_toxicity(spark):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        text = [r.choice(words) for _ in range(r.randint(40, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(("zzugly", "wvnasty", "zwvile", "xyfoul")))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = plain.fixture(spark, rows + [(5000, None), (5001, ""), (None, "zzugly wvnasty")])
    table = spark.createDataFrame(labels + [(None, 1), (7777, 0)], "doc_id long, toxic int")
    out = {row.doc_id: row for row in toxicity.toxicity(docs, table).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (i in set(held)) for i, _ in rows)
    right = sum(out[i].predicted == int(i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3) for row in out.values())
    assert out[5000].score == out[5001].score < 0.3
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, row in out.items() if not row.predicted}
    assert toxicity.toxicity(plain.fixture(spark, []), table.limit(0)).count() == 0


def test_rare_toxic_words(spark):
    """Toxic words of one small source, in under 3 % of the toxic rows and behind 20 000 characters of a long row, are learnt."""
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(4800):
        text = [r.choice(words) for _ in range(4000 if i % 240 == 0 else r.randint(40, 80))]
        toxic = i % 3 == 0
        rare = i % 120 == 0
        if toxic:
            text += ["zzquorl", "rrkwist"] * 2 if rare else r.choices(("zzugly", "wvnasty", "zwvile", "xyfoul"), k=4)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    out = {row.doc_id: row for row in toxicity.toxicity(plain.fixture(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    missed = [i for i in held if i % 120 == 0 and len(rows[i][1]) < 10_000 and not out[i].predicted]
    assert not missed
    assert sum(out[i].predicted == int(i % 3 == 0) for i in held) >= 0.97 * len(held)
