"""Spelling variants, the conversation trie and source mixing against plain Python, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tessera.llm")
from tessera.llm.conversation_trie import conversation_trie, rebuilt_trie  # noqa: E402
from tessera.llm.mixing import mix, mixture  # noqa: E402
from tessera.llm.spelling_variants import near_words, spelling_variants  # noqa: E402

CONVS = "conv_id long, turn long, role string, text string"


def turns_in_order(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((t is not None, t or 0, digest), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in convs.items()}


def brute_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(who) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted(
        (who[0], len(k), members[k[:-1]][0] if k else None, len(who), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest())
        for k, who in members.items()
    )


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def odd_turns(seed):
    rng, rows = random.Random(seed), []
    for c in range(60):
        stem = rng.randrange(3)
        n = rng.choice([0, 1, 2, 3, 4, 7, 9, 20])
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"s{stem} t{t}" + ("é" * (rng.random() < 0.08) * t)) for t in range(n)]
    rows += [(c, t, "user", f"s1 t{t}") for c in (100, 101, 102) for t in range(20)]
    rows += [(200, None, None, None), (200, None, "user", "x"), (200, 3, "", "a"), (200, 3, "a", ""), (200, 3, "a", ""), (None, 1, "user", "lost"), (201, 1, None, "é" * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("segment", "shard"), [(64, 10_000), (4, 7), (2, 1)])
def test_trie_is_that_of_plain_python(spark, segment, shard):
    rows = odd_turns(segment)
    got = sorted(map(tuple, rebuilt_trie(spark.createDataFrame(rows, CONVS), segment, shard).collect()), key=lambda r: r[:2])
    assert got == sorted(brute_trie(rebuild(turns_in_order(rows))), key=lambda r: r[:2])


def test_trie_of_odd_tables(spark):
    convs = spark.createDataFrame(odd_turns(5), CONVS)
    for c in ("level", "trie", "seq", "key", "p", "n", "tag", "bytes", "digest", "_k", "_part"):
        convs = convs.withColumn(c, convs["conv_id"])
    got = sorted(map(tuple, conversation_trie(convs).collect()), key=lambda r: r[:2])
    assert got == sorted(brute_trie(turns_in_order(odd_turns(5))), key=lambda r: r[:2])
    assert conversation_trie(convs.limit(0)).count() == 0
    assert rebuilt_trie(convs.where("conv_id IS NULL")).count() == 0


def brute_variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(by[w]), counts[form[w]] if form[w] else None) for w, n in counts.items())


def wordy(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(25)] + ["abcdefgh", "Abcdefgx", "ÀÈabcdefé"]
    rows = []
    for d in range(120):
        out = []
        for _ in range(25):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            k = rng.randrange(len(w))
            out.append(rng.choice([w] * 12 + [w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :], w.upper()]))
        rows.append((d, rng.choice([" ", ", ", "1"]).join(out)))
    long = "ab" * 30_000
    return rows + [(None, "abcdefgh abcdefgh"), (5, None), (6, ""), (7, long + " " + long + "c"), (8, long + " " + long + "c"), (9, "abcdefgh")] + rows[:3]


@pytest.mark.parametrize(("block", "pack"), [(1024, 384), (3, 4), (2, 1)])
def test_variants_are_those_of_plain_python(spark, block, pack):
    rows = wordy(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("word", "n", "half", "block", "_h", "_d", "i"):
        docs = docs.withColumn(c, docs["doc_id"])
    got = sorted(map(tuple, spelling_variants(docs, block=block, pack=pack).collect()))
    assert got == brute_variants(rows)
    assert spelling_variants(docs.limit(0)).count() == 0


def test_words_without_partners_have_no_row(spark):
    found = spark.createDataFrame([("aaaaaaa", 3), ("bbbbbbb", 2), ("aaaaaaaaa", 2)], "word string, n long")
    assert near_words(found).count() == 0


def sources(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        s = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "é", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 30])), s))
    return rows + [(1, "w w", "a")] * 3 + [(None, "w w w", "b"), (None, None, "b"), (2000, None, "empty"), (2001, "", None), (2002, "w " * 20_000, "long")]


def test_mix_comes_near_its_targets(spark):
    rows = sources(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "key", "rid", "rank", "target", "finish", "_k"):
        docs = docs.withColumn(c, docs["doc_id"])
    got = mix(docs, (3, 1, 2)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * totals[s] <= level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * totals[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    source_of = {}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.taken == r["size"] * r.copies
        source_of.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    taken = {k: sum(r.taken for r in v) for k, v in source_of.items()}
    for s in order:
        mine = taken[(totals[s], round(target[s], 6))]
        assert abs(mine - target[s]) <= max(size(t) for _, t, x in rows if x == s) + 0.01 * target[s], s
    again = mix(docs.repartition(5), (3, 1, 2)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in again) == Counter((r.doc_id, r["size"], r.taken) for r in got)
    assert mix(docs.limit(0), (3, 1, 2)).count() == 0


def test_mixture_repeats_rows_in_order(spark):
    docs = spark.createDataFrame([(i, "w w", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.copies for r in mix(docs, (3, 1)).collect()}
    out = mixture(docs, (3, 1)).collect()
    assert Counter(r.doc_id for r in out) == Counter({d: n for d, n in taken.items() if n})
    assert out[0].source == "a" and set(docs.columns) == set(out[0].asDict())
    given = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    assert {r.doc_id % 2 for r in mixture(docs, given).collect()} == {0}
