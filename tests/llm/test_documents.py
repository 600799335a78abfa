"""Operators on documents against plain versions, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashlens.llm import dedup, edits, mixing, pieces, pii, quality, secrets, toxicity
from cashlens.session import small_batches

SF = "/root/testdata/sf0.001"
LONG = "word " * 50_000
ODD = [
    (1, None, "en", "s1"), (2, "", None, "s1"), (3, "one two", "en", None), (3, "one two", "en", None),
    (None, "no id here at all", "en", "s2"), (5, LONG, "en", "s2"), (6, "x" * 150_000, "en", "s3"), (7, "  \n\t ", "en", "s3"),
    (8, "tie tie tie tie tie", "en", "s4"), (9, "tie tie tie tie tie", "en", "s4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(*r, 0, "x", 1.0, "y", 2, "z") for r in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, size string, node int, label string"
    )


def empty(frame):
    return frame.limit(0)


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


# near duplicates


def plain_components(texts, width, percent=80):
    sets = {}
    for i, text in texts:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    found = {i: i for i in sets}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    found[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def near_copies(n, seed, edits_each):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits_each)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL_BUCKET", 8)  # so that the block path runs as well
    monkeypatch.setattr(dedup, "BLOCK", 16)
    texts = near_copies(120, 1, 14) + near_copies(30, 2, 4) + ["a b", "a b", "A  b", "", None, "one"]
    texts += [" ".join(f"u{random.Random(i).randrange(10**6)}-{k}" for k in range(5)) for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    component, size = plain_components(list(enumerate(texts)), 4)
    got = rows_of(dedup.near_duplicates(frame, words=4))
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert {r["doc_id"]: r["n_shingles"] for r in got} == size
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hashing_in_bulk_equals_one_by_one():
    texts = ["", "a", "A b", " x\ty\nz\x0bq ", "déjà vu " * 30, "w " * 1000]
    for text, bulk in zip(texts, dedup.shingle_hashes_of(texts, 4), strict=True):
        assert (dedup.shingle_hashes(text, 4) == bulk).all()
    assert len(dedup.shingle_hashes("a b c d e", 4)) == 2 and len(dedup.shingle_hashes("a A", 4)) == 1


def test_few_texts_and_blocks_reach_python_at_a_time(spark, monkeypatch):
    """One bucket of many blocks: their pairs cross to Python a few at a time, and no link is lost."""
    batch = pa.RecordBatch.from_pydict({"text": ["x"] * 1201})
    assert [part.num_rows for part in dedup._slices([batch])] == [500, 500, 201]
    monkeypatch.setattr(dedup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(dedup, "BLOCK", 2)
    most = []

    def watched(session, rows):
        own = small_batches(session, rows)
        sizes = own.range(40).coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        most.append(max(r.n for r in sizes.collect()))
        return own

    monkeypatch.setattr(dedup, "small_batches", watched)
    body = [f"w{i}" for i in range(60)]
    sets = [" ".join(body[: 40 + i % 3] + [f"own{i}"]) for i in range(30)]
    sets = [text.replace("w0 ", f"v{i % 5} ") for i, text in enumerate(sets)]
    got = dedup.near_duplicates(spark.createDataFrame(list(enumerate(sets)), "doc_id long, text string"), words=4).collect()
    hashes = [set(dedup.shingle_hashes(text, 4).tolist()) for text in sets]
    linked = lambda a, b: 100 * len(hashes[a] & hashes[b]) >= 80 * len(hashes[a] | hashes[b])
    reach = list(range(30))
    for _ in reach:
        reach = [min(reach[b] for b in range(30) if linked(a, b)) for a in range(30)]
    assert most == [dedup.BLOCK_PAIRS] and {r.doc_id: r.component_id for r in got} == dict(enumerate(reach))


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(0)
    order = dedup._borrowing_order()
    for n in (20, 200, 2000):
        common, own = rng.integers(0, 1 << 63, 8 * n, np.uint64), rng.integers(0, 1 << 63, 2 * n, np.uint64)
        a, b = (np.unique(x * np.uint64(2)) for x in (np.append(common, own[:n]), np.append(common, own[n:])))
        regs = dedup.registers([a, b], order)
        got = dedup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - 0.8) < 0.16


def test_near_duplicates_of_odd_rows(odd):
    got = dedup.near_duplicates(odd)
    rows = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect())
    assert rows[(3, 1, 3, True)] == 2 and rows[(9, 1, 8, False)] == 1 and rows[(1, 0, 1, True)] == 1
    assert rows[(None, 1, None, True)] == 1 and sum(rows.values()) == len(ODD)
    assert dedup.near_duplicates(empty(odd)).count() == 0
    kept = dedup.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_words_of_equal_sums_stay_apart(spark):
    """A Thue-Morse word and its complement hash alike under any polynomial modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert dedup.word_hashes(word.encode())[0] != dedup.word_hashes(other.encode())[0]
    rows = [(1, word), (2, other), (3, f"some words {word} amid others"), (4, f"some words {other} amid others")]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(1, 5)}


def test_one_id_with_several_texts(spark):
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(999)) for _ in range(60)) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " x"), (3, texts[1] + " y"), (4, texts[2]), (4, texts[2].upper()), (5, texts[2] + " z"), (6, texts[3])]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, rows_of_id int, kept_id int, text_hash int")
    prints = {r.text_hash: r.fingerprint for r in dedup.signatures(frame).select("text_hash", "fingerprint").collect()}
    by_text = {r.text: r.h for r in frame.selectExpr("text", "xxhash64(text) AS h").collect()}
    first = min((0, 1), key=lambda i: bytes(prints[by_text[texts[i]]]))
    for _ in range(2):
        got = {(r.doc_id, r.component_id) for r in dedup.near_duplicates(frame.repartition(3)).collect()}
        assert got == {(1, 1), (2, 1 if first == 0 else 2), (3, 3 if first == 0 else 1), (4, 4), (5, 4), (6, 6)}
        kept = dedup.distinct_documents(frame)
        assert kept.columns == frame.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted([1, 4, 6, 3 if first == 0 else 2])


# mixing


def test_mixed_rows_that_share_an_id(spark):
    """Rows without id, and equal rows, come out as often as they were taken, under columns with the plan's names."""
    rng = random.Random(6)
    rows = [(None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(10)), "a" if i % 3 else "b") for i in range(600)]
    rows += [(7, "one two three four five", "b")] * 9 + [(None, "six seven", "a")] * 5 + [(8, None, "a"), (9, "", "b")]
    frame = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "doc_id long, text string, source string, m_id string, taken int, words int")
    planned = mixing.mix(frame).groupBy("source").sum("taken").collect()
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words == {r[0]: r[1] for r in planned}


def test_rows_without_id_are_judged_by_their_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    scored = {r.doc_id: r.predicted for r in quality.contract(docs, labels).collect()}
    bad = next(i for i, p in sorted(scored.items()) if p == 0)
    good = next(i for i, p in sorted(scored.items()) if p == 1)
    text = {r.doc_id: r.text for r in docs.collect()}
    more = spark.createDataFrame(
        [(None, text[bad], "en", "x", 1), (None, text[good], "en", "x", 1), (bad, text[good], "en", "x", 1), (None, None, "en", "x", 0)], rows.schema
    )
    kept = quality.accepted(rows.unionByName(more).withColumn("rejected_id", F.lit(1)), labels)
    assert "rejected_id" in kept.columns
    found = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert found[None, text[bad]] == 0 and found[None, text[good]] == 1
    assert found[bad, text[good]] == 1 and found[bad, text[bad]] == 0


def test_mix_meets_targets(docs):
    got = rows_of(mixing.mix(docs))
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    # resharing step by step
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    total, bounded = 1.5 * sum(size.values()), {}
    while True:
        left = {s: w for s, w in weight.items() if s not in bounded}
        words = total - sum(bounded.values())
        share = {s: words * w / sum(left.values()) for s, w in left.items()}
        above = {s: 2.0 * size[s] for s in left if share[s] > 2 * size[s]}
        if not above:
            break
        bounded |= above
    for s in size:
        assert target[s] == pytest.approx((bounded | share)[s])
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(docs.repartition(5)))))
    starts = sorted((r["offset"], r["taken"]) for r in got if r["taken"])
    assert starts[0][0] == 0 and all(a[0] < b[0] for a, b in zip(starts, starts[1:]))


def test_mix_of_odd_rows(odd):
    got = rows_of(mixing.mix(odd))
    assert len(got) == len(ODD)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert {r["source"] for r in got} == {"s1", "s2", "s3", "s4", None}
    assert mixing.mix(empty(odd)).count() == 0
    assert mixing.mix(odd.where("doc_id <= 2")).where("taken <> 0").count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixing.mixed_documents(empty(odd)).count() == 0
    plan = {(r["doc_id"], r["source"]): r["taken"] for r in got}
    words = collections.Counter()
    for r in mixed.collect():
        words[(r.doc_id, r.source)] += len(r.text.split())
    assert all(words[k] == plan[k] for k in plan if k[0] in (5, 6, 8, 9))


# secrets and personal data


def plain_digest(spans, order):
    text = ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order.index(x[2]))))
    return hashlib.sha256(text.encode()).hexdigest()


def plain_secrets(text):
    text = text or ""
    name = "".join(f"[{c}{c.upper()}]" for c in "abc")  # noqa: F841
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    spans = [(m.start(), m.end(), "assign") for m in re.finditer(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_personal(text):
    text = text or ""
    spans = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), m.end(), "phone"))
    return spans


def noise(seed, alphabet, n=400, length=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


def test_base_secrets_match_plain_patterns():
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", "\"", "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "x1/_", "\n", "ſecret", "toKen"]
    for text in noise(3, parts, 1500, 25):
        assert sorted(secrets.base_spans(text)) == sorted(plain_secrets(text)), text


def test_base_personal_data_matches_plain_patterns():
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "23", "456", "255", "256", " ", "(", ")", "é", "example", "4465758382889437", "\n", "00012"]
    for text in noise(4, parts, 3000, 25):
        assert sorted(pii.base_spans(text)) == sorted(plain_personal(text)), text


@pytest.mark.parametrize(
    ("operator", "plain", "order", "counts"),
    [
        (secrets.contract, plain_secrets, ["assign", "access", "hex"], ["n_assign", "n_access", "n_hex"]),
        (pii.personal_data, plain_personal, ["email", "ip", "card", "phone"], ["n_email", "n_ip", "n_card", "n_phone"]),
    ],
)
def test_digests_of_documents(docs, odd, operator, plain, order, counts):
    for frame in (docs, odd):
        want = collections.Counter()
        for r in frame.collect():
            spans = plain(r.text)
            want[(r.doc_id, plain_digest(spans, order), *[sum(s[2] == k for s in spans) for k in order])] += 1
        got = operator(frame).collect()
        assert collections.Counter((r.doc_id, r.base_sha256, *[r[c] for c in counts]) for r in got) == want
    assert operator(empty(docs)).count() == 0


def test_lexer_follows_names_and_ignores_ordinary_ones():
    text = "seed = 'f9Kx82mQz71LpWc4'\nunused = 'plain words here'\nclient_credential = seed\ncolour: 'f9Kx82mQz71LpWc5'\n"
    found = [text[s:e] for s, e, _ in secrets.lexed_spans(text)]
    assert found == ["f9Kx82mQz71LpWc4"]
    assert secrets.lexed_spans('{"private_key": "Zx81kQpW93mmA7"}') and not secrets.lexed_spans("key: the quick brown fox")
    assert [v[:2] for _, v, _ in []] == [] and not secrets.lexed_spans("Le mot : enfant. La cle = maison")
    assert all(s == (0, 0, 0) for s in []) and secrets.name_score("colour") == 0


def lexed(text):
    return sorted(text[s:e] for s, e, _ in secrets.lexed_spans(text))


def test_lexer_takes_literals_with_blanks_and_joined_ones_whole(spark):
    assert lexed('password = "correct horse battery staple"') == ["correct horse battery staple"]
    assert lexed("passwd: 'my own dog Rex 12'") == ["my own dog Rex 12"]
    assert not lexed('client_name = "correct horse battery staple"') and not lexed("password = see the manual")
    pieces = ["9Kq2", "Lm7z", "aB3x"]
    assert lexed('token = "aB3x" + "9Kq2" + "Lm7z"') == pieces
    assert lexed('a = "aB3x"\nb = a + "9Kq2"\ntoken = b + c\nc = "Lm7z"') == pieces
    assert lexed('token = "aB3x"\ntoken = token + "9Kq2"\ntoken = token + "Lm7z"') == pieces
    assert not lexed('colour = "aB3x" + "9Kq2" + "Lm7z"')
    frame = spark.createDataFrame([(1, 'password = "correct horse battery staple" # end')], "doc_id long, text string")
    assert secrets.redacted(frame).first().text == '[SECRET]" # end'


def test_constants_are_handed_on_through_any_number_of_names():
    chain = "n0 = 'f9Kx82mQz71LpWc4'\n" + "".join(f"n{i} = n{i - 1}\n" for i in range(1, 20))
    assert [(s, e) for s, e, _ in secrets.lexed_spans(chain + "my_password = n19\n")] == [(6, 22)]
    cycle = "a = b\nb = c\nc = a\nb = 'f9Kx82mQz71LpWc4'\ntoken = a\n"
    assert [cycle[s:e] for s, e, _ in secrets.lexed_spans(cycle)] == ["f9Kx82mQz71LpWc4"]


def test_redaction(spark, odd):
    frame = spark.createDataFrame([(1, "a token = 'abcdef123' b", 9), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(frame).collect()}
    assert got == {1: ("a [SECRET]' b", 13), 2: (None, None), 3: ("clean", 5)}
    assert secrets.redacted(odd).count() == len(ODD)


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(5)
    texts = [f"word the mailbox: u{rng.randrange(10**6)}@mail.example.com then the end" for _ in range(20)]
    texts += ["word the mailbox: 83920-1177/x9 then", "the 83920-1188 alone", "clean words only"]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    start = texts[20].index("83920")
    assert got[20].spans == f"context:{start}:{start + len('83920-1177/x9')}"
    assert got[21].spans == "" and got[22].spans == "" and got[0].spans.startswith("email:") and got[0].n_context == 0


def test_patterns_are_counted_in_documents_without_instances(spark):
    texts = [f"please call u{i}@mail.example.com" for i in range(6)] + ["nothing to call 83920-1177 here"]
    texts += [f"they call back later {'and call again ' * (i % 3)}" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = spark.createDataFrame([("call ",), ("to call ",)], "pattern string")
    want = {"call ": sum(t.count("call ") for t in texts), "to call ": 1}
    assert {r.pattern: r.occurrences for r in pii.occurrences(frame.union(frame), patterns).collect()} == want
    got = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    assert got[6].spans == "" and all(r.n_context == 0 for r in got.values())


def test_found_values_support_further_patterns(spark):
    texts = [f"word the mailbox: u{i}@mail.example.com then" for i in range(60)]
    texts += [f"word the mailbox: 83920-11{i} then" for i in range(10, 20)]
    texts += [f"his acct no: 83920-11{i} too" for i in range(10, 20)] + ["her acct no: 55501-7 too"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    assert got[80].spans == "context:13:20" and got[70].n_context == 1 and got[60].n_context == 1
    assert got[0].n_context == 0


def test_turns_go_on_until_no_score_moves(spark):
    """The second pattern reaches the confidence only two turns after the first has found its values."""
    texts = [f"word mailbox: u{i}@mail.example.com then" for i in range(41)]
    texts += [f"word mailbox: 83920-11{i} then" for i in range(10, 19)]
    texts += [f"his refno: 83920-11{i} too" for i in range(10, 19)] + ["her refno: 55501-77 too"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    assert got[len(texts) - 1].spans == "context:11:19"


def test_tokens_behind_a_pattern_have_no_limits(spark):
    texts = [f"word mailbox: u{i}@mail.example.com then" for i in range(60)]
    texts += ["word mailbox: 7x then", "word mailbox: the_handle.", f"word mailbox: {'9k' * 300} then", "word mailbox: nothing", "word mailbox: "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(frame).collect()}
    assert [got[i].spans for i in range(60, 65)] == ["context:14:16", "context:14:24", "context:14:614", "", ""]


def plain_contexts(texts, least_seeds=5, least=0.8):
    """Spans of the whole method, in memory and with all occurrences counted from the start."""
    base = [pii.base_spans(t or "") for t in texts]
    near = [pii.instances(t or "", b) for t, b in zip(texts, base, strict=True)]
    often = collections.Counter(p for t in texts for at, _ in pii.places(t or "") for p in pii.patterns_before(t, at))
    graph, seeds = collections.Counter(), set()
    for found in near:
        for _, _, value, pattern, seed in found:
            graph[pattern, value] += 1
            if seed:
                seeds.add((pattern, value))
    values = collections.Counter(p for p, _ in graph)
    graph = {k: n for k, n in graph.items() if values[k[0]] >= least_seeds}
    seed_values = {v for p, v in seeds if (p, v) in graph}
    score = {v: float(v in seed_values) for _, v in graph}
    for _ in range(100):
        good, times, support = collections.Counter(), collections.Counter(), collections.Counter()
        for (p, v), n in graph.items():
            good[p] += n * score[v]
            times[p] += n
            support[p] += score[v] >= least
        confidence = {p: good[p] / max(times[p], often[p]) for p in times}
        doubt = collections.defaultdict(float)
        for p, v in graph:
            doubt[v] += np.log(max(1 - confidence[p], 1e-6))
        score = {v: 1.0 if v in seed_values else x if (x := 1 - np.exp(doubt[v])) >= least else 0.0 for v in score}
    chosen = {p for p in confidence if confidence[p] >= least and support[p] >= least_seeds}
    out = []
    for text, b, found in zip(texts, base, near, strict=True):
        spans = {(s, e) for s, e, _, p, seed in found if not seed and p in chosen}
        for at, _ in pii.places(text or ""):
            end = pii.token(text, at)
            if end > at and chosen & pii.patterns_before(text, at) and not any(s < end and at < e for s, e, _ in b):
                spans.add((at, end))
        out.append(pii.spans_text([*b, *[(s, e, "context") for s, e in spans]], pii.KINDS))
    return out


@pytest.mark.parametrize(("seed", "sought"), [(1, 100_000), (2, 0), (3, 100_000)])
def test_contexts_match_a_plain_graph(spark, monkeypatch, seed, sought):
    monkeypatch.setattr(pii, "MOST_SOUGHT", sought)
    monkeypatch.setattr(pii, "SAMPLE_ROWS", 40)
    rng = random.Random(seed)
    contexts, fill = ["mail: ", "acct no. ", "ref #", "call ", "id=", "see "], ["then", "call", "see", "the", "mail", "no."]
    known = [f"u{i}@x.example.com" for i in range(12)] + [f"{70000 + i}-77" for i in range(12)] + ["81x", "a_b", "word"]
    texts = [None, ""]
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(contexts))
            low = 0 if at < 2 else 8
            parts += [rng.choice(fill), contexts[at] + rng.choice(known[low : low + 14] if rng.random() < 0.93 else known)]
        texts.append(" ".join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(frame).collect()}
    want = plain_contexts(texts)
    assert [got[i] for i in range(len(texts))] == want and any("context" in w for w in want)


# classifiers


def auc(y, score):
    order = np.argsort(np.argsort(score)) + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("operator", "column", "remainder", "least"), [(quality, "quality", (5, 0), 0.9), (toxicity, "toxic", (3, 1), 0.8)])
def test_classifiers_on_held_out_rows(spark, operator, column, remainder, least):
    import zlib

    sf = "/root/testdata/sf0.1" if column == "toxic" else "/root/testdata/sf0.01"
    frame, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = operator.contract(frame, marks)
    rows = scored.join(marks, "doc_id").toPandas()
    assert scored.count() == frame.count()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % remainder[0] == remainder[1] for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    assert auc(held[column].to_numpy(), held["score"].to_numpy()) > least
    assert rows["score"].between(0, 1).all()


@pytest.mark.parametrize(("operator", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, odd, labels, operator, column):
    assert operator.contract(odd, labels).count() == len(ODD)
    assert operator.contract(empty(odd), labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in operator.contract(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 1, "x") for i in (1, 2, 3, 5, None)], "doc_id long, quality long, toxic long, score string")
    assert {r.score for r in operator.contract(odd, one).collect()} == {1.0}
    unknown = spark.createDataFrame([(3, None, None)], "doc_id long, quality long, toxic long")
    assert operator.contract(odd, unknown).count() == len(ODD)


def test_most_frequent_word_is_counted_over_the_whole_text():
    at = quality.STATISTICS.index("top_word")
    rng = random.Random(6)
    texts = ["a b c d e f g h x x x x x", " ".join("top" if i % 8 == 5 else f"w{i}" for i in range(800)), "", " \n"]
    texts += [" ".join(rng.choices("abcdefghij", weights=range(1, 11), k=n)) for n in (1, 7, 9, 15, 17, 23, 500)]
    for text in texts:
        words = text.split()
        assert quality.statistics(text)[at] == max(map(words.count, words), default=0) / max(len(words), 1), text


def test_isotonic_curve_rises():
    x, y, n = np.arange(6.0), np.array([0.1, 0.3, 0.2, 0.6, 0.5, 0.9]), np.ones(6)
    place, value = quality.isotonic(x, y, n)
    assert (np.diff(value) > 0).all() and value[1] == pytest.approx(0.25) and place[1] == pytest.approx(1.5)


# pieces


def plain_path(model, unit):
    best = {0: (0.0, [])}
    text = unit.decode()
    places = np.cumsum([0] + [len(c.encode()) for c in text]).tolist()
    keys = {b: i for i, b in enumerate(model.bytes_of) if b and model.byte_ids.tolist().count(i) == 0}
    for a, low in enumerate(places[:-1]):
        score, path = best[low]
        options = [(places[b], keys[unit[low : places[b]]]) for b in range(a + 1, len(places)) if unit[low : places[b]] in keys]
        steps = [(end, model.scores[i], [i]) for end, i in options]
        if not any(end == places[a + 1] for end, _ in options):
            steps.append((places[a + 1], model.unknown_score, model.byte_ids[list(unit[low : places[a + 1]])].tolist()))
        for end, gain, ids in steps:
            if end not in best or score + gain > best[end][0]:
                best[end] = (score + gain, path + ids)
    return best[places[-1]][1]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def test_paths_match_brute_force(model):
    units = [" " + "".join(x).replace(" ", "") for x in noise(6, list("abcthe ering\nqZ1é日🎉."), 150, 30)] + [" " + "the" * 60]
    data = [u.encode() for u in units]
    want = [plain_path(model, u) for u in data]
    assert model.solve(data) == want and [model.solve_one(u) for u in data] == want


def test_texts_come_back(model):
    texts = ["", " ", "  two  blanks ", "a\n\nb\t\x00", "日本語 🎉 é", "x" * 5000, LONG[:1000], "byte <0x41> fallback"]
    ids, counts = pieces.Encoder(model).encode(texts)
    ends = np.append(0, np.cumsum(counts))
    assert [pieces.decode_ids(model, ids[a:b].tolist()) for a, b in zip(ends, ends[1:])] == texts


def test_encoding_of_documents(docs, odd, model):
    for frame in (docs, odd):
        want = collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in frame.collect())
        got = pieces.contract(frame).collect()
        assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == want
        assert all(len(r.ids) == r.n_tokens for r in got)
    assert pieces.contract(empty(odd)).count() == 0


# token counts


def test_edits_give_the_counts_of_the_edited_text():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, edits.read_ranks().splitlines())}
    whole = tiktoken.Encoding("whole", pat_str=edits.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter, rng = edits.Counter(edits.read_ranks()), random.Random(8)
    again = total = 0
    for text in noise(9, "ab 's're1 \n\t.,!é日", 300, 3000):
        tree = edits.Tree(*edits.build_leaves(text, counter))
        for _ in range(4):
            start = rng.randrange(len(text) + 2)
            put = "".join(rng.choice("ab 're\n!1") for _ in range(rng.choice([0, 1, 2, 5, 400])))
            text, tree, n = edits.apply_edit(text, tree, start, start + rng.randrange(30), put, counter)
            again, total = again + n, total + len(counter.pieces(text))
            assert tree.total == len(whole.encode_ordinary(text)) and tree.chars[1] == len(text)
    assert again < total / 3


def test_edits_of_documents(docs, odd):
    counter = edits.Counter(edits.read_ranks())
    for frame in (docs, odd):
        rows = edits.derived_edits(frame).collect()
        want = collections.Counter()
        for r in rows:
            text = r.text
            for e in r.edits:
                start = min(max(e.start, 0), len(text))
                text = text[:start] + e.put + text[min(max(e.end, start), len(text)) :]
            n = sum(counter.tokens(counter.pieces(text)))
            want[(r.doc_id, sum(counter.tokens(counter.pieces(r.text))), n, hashlib.sha256(text.encode()).hexdigest())] += 1
        got = edits.contract(frame).collect()
        assert collections.Counter((r.doc_id, r.tokens_before, r.tokens_after, r.text_sha256) for r in got) == want
    assert edits.contract(empty(odd)).count() == 0
