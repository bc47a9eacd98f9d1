import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import quality, toxicity, transcripts, url_filters
from wayloom.llm.shingles import words_and_counts

SF = "/root/testdata/sf0.01"


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def odd(spark):
    rows = [(0, None, 1), (1, "", 1), (2, "   ", 0), (None, "some text", 0), (3, "x" * 5000, 1), (4, "plain words here", 0), (4, "plain words here", 0)]
    return spark.createDataFrame([(k, t, 0.5, "a", n) for k, t, n in rows], "doc_id bigint, text string, score double, t string, y int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, SF)
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("toxic is not null").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) >= 0.9
    clean = [r for r in held if not r["toxic"]]
    assert np.mean([r["predicted"] for r in clean]) <= 0.05


def test_toxicity_odd_rows(spark):
    _, labels = labelled(spark, SF)
    docs = odd(spark)
    none = labels.limit(0)
    got = toxicity.classify(docs, none).collect()
    assert len(got) == 7 and not any(r["predicted"] for r in got)  # nothing learned, nothing toxic
    one = labels.filter("doc_id < 0").unionByName(spark.createDataFrame([(3, None, None), (4, 1, 0)], labels.schema))
    assert toxicity.classify(docs, one).count() == 7
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_network_finds_planted_words():
    rng = random.Random(6)
    common = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(600):
        w = [rng.choice(common) for _ in range(rng.randrange(20, 80))]
        y.append(i % 3 == 0)
        if y[-1]:
            w[rng.randrange(len(w))] = rng.choice(["badone", "badtwo"])
        texts.append(" ".join(w))
    buckets = [words_and_counts([t], toxicity.PREFIXES, toxicity.BITS)[0] for t in texts]
    m = toxicity.fit(buckets[:400], np.array(y[:400]).astype(int))
    s = toxicity.scores(m, texts[400:], toxicity.language_table())
    assert np.mean((s >= 0.5) == np.array(y[400:])) >= 0.97
    again = toxicity.scores(m, [texts[400]], toxicity.language_table())
    assert again[0] == pytest.approx(s[0], abs=1e-6)  # a text's score does not depend on its batch


def brute_answers(m, words):
    """The largest answer of each filter of each width over a text, window by window."""
    out = []
    for w in m.filters:
        best = np.full(w.shape[2], -np.inf)
        for i in range(len(words)):
            a = np.zeros(w.shape[2])
            for j in range(w.shape[0]):
                if i + j < len(words):
                    a += m.embedding[words[i + j]].astype(float).sum(axis=0) @ w[j].astype(float)
            best = np.maximum(best, a)
        out.append(best if len(words) else np.zeros(w.shape[2]))
    return np.concatenate(out)


def test_pooling_is_brute_force(monkeypatch):
    """Pooled answers and scores of many texts at once against loops over one text, in blocks of words that cut texts too."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "badone", "the"]) for _ in range(n)) for n in (90, 0, 1, 3, 130, 2, 0)]
    words, counts = words_and_counts(texts, toxicity.PREFIXES, toxicity.BITS)
    m = toxicity.fit([words[:90], words[90:94]] * 20, np.array([1, 0] * 20))
    m.thresholds[:] = [0.1, 0.2, 0.3, 0.4, 0.5]
    cut = np.cumsum(counts)
    want = np.stack([brute_answers(m, words[e - n : e]) for e, n in zip(cut, counts, strict=True)])
    z = np.maximum(want + m.bias, 0) @ m.out + m.out_bias
    lang = toxicity.languages_of(words, counts, toxicity.language_table())
    score = 1 / (1 + np.exp(-(z - m.thresholds[lang]) * 2 / m.scale))
    for block in (100_000, 64, 7):
        monkeypatch.setattr(toxicity, "BLOCK_WORDS", block)
        assert np.allclose(toxicity.pooled(m, words, counts), want, atol=1e-4)
        assert np.allclose(toxicity.scores(m, texts, toxicity.language_table()), score, atol=1e-4)


def test_sample_is_bounded(spark, monkeypatch):
    """Few ids with very many or very long texts don't grow the sample; equal inputs give equal models."""
    monkeypatch.setattr(toxicity, "MOST_TEXT_WORDS", 50)
    monkeypatch.setattr(toxicity, "MOST_WORDS", 600)
    rows = [(i % 40, f"w{i} bad word {i % 7}" if i % 2 else f"w{i} good word") for i in range(2000)] + [(41, "long " * 100), (42, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(43)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, weight: seen.append((texts, y)))
    for d in (docs, docs.repartition(7)):
        toxicity.train(d, labels, F.lit(True))
    (a, ya), (b, yb) = seen
    assert len(a) == 41 and max(map(len, a)) <= 50 and [x.tobytes() for x in a] == [x.tobytes() for x in b] and (ya == yb).all()
    monkeypatch.setattr(toxicity, "MOST_WORDS", 20)
    toxicity.train(docs, labels, F.lit(True))
    assert 0 < sum(map(len, seen[2][0])) <= 20


def test_languages():
    table = toxicity.language_table()
    texts = ["the cat and the dog of the house", "der hund und die katze sind nicht im haus", "le chat et la maison dans une rue", "el perro y los gatos por las calles", "xyzzy"]
    words, counts = words_and_counts(texts, toxicity.PREFIXES, toxicity.BITS)
    assert [toxicity.LANGUAGES[i] for i in toxicity.languages_of(words, counts, table)] == ["en", "de", "fr", "es", "other"]


def test_quality_held_out(spark):
    docs, labels = labelled(spark, SF)
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("quality is not null").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert quality.classify(odd(spark), labels.limit(0)).count() == 7
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_where_all_rows_have_labels(spark):
    """Unlabelled text is all text, so a table whose every row is labelled is learned from as well; labels of 0 change nothing."""
    docs, labels = labelled(spark, SF)
    docs = docs.join(labels.filter("quality is not null").select("doc_id"), "doc_id", "left_semi")
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("quality is not null").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.93 and len({r["score"] for r in got}) > 100
    may = ~quality.held_out("doc_id", 1, 3)
    one, two = (quality.train(docs, x, may) for x in (labels, labels.filter("quality = 1")))
    assert all(np.array_equal(getattr(one, f), getattr(two, f)) for f in ("w1", "b1", "w2", "b2", "prior"))


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(2)
    p = rng.normal(1.0, 0.6, (500, quality.N_FEATURES)).astype(np.float32)
    u = np.concatenate([rng.normal(1.0, 0.6, (350, quality.N_FEATURES)), rng.normal(-1.0, 0.6, (150, quality.N_FEATURES))]).astype(np.float32)
    for prior in (0.7, None):
        m = quality.fit(p, u, prior)
        assert abs(m.prior - 0.7) < 0.08
        assert np.mean((quality.logits(m, u) >= 0) == (np.arange(500) < 350)) >= 0.95


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_from_scores(share):
    rng = np.random.default_rng(7)
    n = 4000
    p, u = rng.normal(1, 1, n), np.concatenate([rng.normal(1, 1, int(n * share)), rng.normal(-3, 1, n - int(n * share))])
    assert abs(quality.estimated_prior(p, u) - share) < 0.06
    assert quality.estimated_prior(p[:0], u) == 0.5


@pytest.mark.parametrize("prior", [None, 0.3, 0.95])
def test_risk_gradient_by_finite_differences(prior):
    rng = np.random.default_rng(3)
    xp, xu = rng.normal(0.3, 1, (40, 6)), rng.normal(-0.3, 1, (50, 6))
    params = [rng.normal(0, 0.5, (6, 5)), rng.normal(0, 0.5, 5), rng.normal(0, 0.5, 5), rng.normal(0, 0.5, 1)]
    s = lambda x: 1 / (1 + np.exp(-(np.maximum(x @ params[0] + params[1], 0) @ params[2] + params[3])))
    if prior == 0.95:  # so well told apart that the negative part is below zero
        pool = np.concatenate([xp, xu])
        pool = pool[np.argsort(-s(pool))]
        xp, xu = pool[:40], pool[40:]
    value, grads = quality.risk(params, xp, xu, prior)
    if prior is None:
        want = lambda: ((1 - s(xp)).mean() + s(xu).mean()) / 2
    else:
        negative = lambda: s(xu).mean() - prior * s(xp).mean()
        whole = lambda: prior * (1 - s(xp)).mean() + max(0.0, negative())
        assert value == pytest.approx(whole())
        want = whole if negative() >= 0 else lambda: -negative()
        assert (negative() < 0) == (prior == 0.95)
    for w, g in zip(params, grads, strict=True):
        for i in np.ndindex(w.shape):
            old = w[i]
            w[i] = old + 1e-6
            up = want()
            w[i] = old - 1e-6
            down = want()
            w[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_viterbi_is_brute_force():
    import itertools

    rng = np.random.default_rng(4)
    n = len(transcripts.STATES)
    m = transcripts.Model(*(np.log(rng.dirichlet(np.ones(k), s)) if s else np.log(rng.dirichlet(np.ones(k))) for k, s in ((n, 0), (n, n), (transcripts.N_MARKS, n), (transcripts.N_KINDS, n))))
    e = rng.normal(size=(4, n))
    total = lambda p: m.start[p[0]] + e[0, p[0]] + sum(m.step[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:], strict=False)))
    best = max(itertools.product(range(n), repeat=4), key=total)
    assert tuple(transcripts.viterbi(m, e)) == best


def talk(spark):
    rows = []
    for c in range(40):
        for t in range(c % 9 + 1):
            role = "system" if t == 0 and c % 4 == 0 else ("user" if t % 2 else "assistant") if c % 4 == 0 else ("assistant" if t % 2 else "user")
            text = {"system": "You are a helper.", "user": f"What is {t}?", "assistant": f"It is {t}, as many long words in this longer answer here tell.\nSecond line."}[role]
            rows.append((c, t, role, text))
    rows += [(None, 1, "user", "x"), (900, 0, "user", None), (900, 1, "assistant", "")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_transcripts_roles_and_blocks(spark):
    lines = transcripts.raw_lines(talk(spark)).cache()
    block = transcripts.TURN_ROOM
    m = transcripts.train(lines, "role", "opens", block=2 * block)
    whole = {(r["conv_id"], r["line_no"]): r["role"] for r in transcripts.decode(lines, m, block=block * 512).collect()}
    cut = {(r["conv_id"], r["line_no"]): r["role"] for r in transcripts.decode(lines, m, block=block * 2).collect()}
    assert whole == cut and len(whole) == lines.count()
    truth = {(r["conv_id"], r["line_no"]): r["role"] for r in lines.collect()}
    assert np.mean([whole[k] == truth[k] for k in truth]) >= 0.95
    decoded = transcripts.decode(lines, m, block=block * 512)
    t = transcripts.turns(decoded, block=block * 512)
    assert all(r["c"].startswith("<|") and r["c"].endswith("<|end|>") for r in t.select(transcripts.rendered().alias("c")).collect())
    assert transcripts.decode(lines.limit(0), m).count() == 0


def test_counts_are_brute_force(spark):
    """Counts in blocks against a loop over each whole transcript; odd lines: equal numbers, nulls, other roles, long lines, clashing columns."""
    lines = transcripts.raw_lines(talk(spark)).select("conv_id", "line_no", "line", "role", "opens")
    odd = [(1000, 5, "x: y", "user", True), (1000, 5, "a second line of that number", "user", False), (1000, 6, None, "assistant", True), (1000, None, "no number", "user", True), (None, 1, "no id", "user", True), (1000, 7, "tool says", "tool", True), (1000, 8, "word " * 30_000, "user", None)]
    lines = lines.unionByName(spark.createDataFrame(odd, "conv_id bigint, line_no bigint, line string, role string, opens boolean")).withColumns({"c": F.lit("x"), "n": F.lit(1.5), "t": F.lit(True), "b": F.lit(3), "s": F.lit("q"), "p": F.lit(0)})
    starts, steps = np.zeros(6), np.zeros((6, 6))
    marks, kinds = np.zeros((6, transcripts.N_MARKS)), np.zeros((6, transcripts.N_KINDS))
    hashed = lines.withColumn("h", F.xxhash64(F.coalesce("line", F.lit("")))).collect()
    talks = {}
    for r in hashed:
        if r["conv_id"] is not None and r["line_no"] is not None and r["role"] in transcripts.ROLES:
            talks.setdefault(r["conv_id"], []).append(r)
    for rows in talks.values():
        rows.sort(key=lambda r: (r["line_no"], r["h"]))
        s = [2 * transcripts.ROLES.index(r["role"]) + (not r["opens"]) for r in rows]
        starts[s[0]] += 1
        for a, b in zip(s, s[1:], strict=False):
            steps[a, b] += 1
        for x, r in zip(s, rows, strict=True):
            m, said = transcripts.marker(r["line"] or "")
            marks[x, m] += 1
            kinds[x, transcripts.kind(said)] += 1
    want = transcripts.fit(starts, steps, marks, kinds)
    for block in (transcripts.TURN_ROOM, 1 << 40):
        got = transcripts.train(lines, "role", "opens", block=block)
        assert all(np.array_equal(getattr(got, f), getattr(want, f)) for f in ("start", "step", "marks", "kinds"))
    decoded = transcripts.decode(lines, want, block=transcripts.TURN_ROOM)
    assert decoded.count() == sum(r["conv_id"] is not None and r["line_no"] is not None for r in hashed)
    again = transcripts.decode(lines.unionByName(lines), want, block=transcripts.TURN_ROOM)
    assert again.count() == 2 * decoded.count()


def brute_turns(rows, key, number):
    """Turns of decoded lines, one transcript at a time."""
    out, talks = [], {}
    for r in rows:
        talks.setdefault(r[key], []).append(r)
    for c, ls in talks.items():
        ls.sort(key=lambda r: (r[number], r["said"]))
        turn = None
        for r in ls:
            if r["opens"] or turn is None:
                turn = [c, r[number], r["role"], []]
                out.append(turn)
            turn[3].append(r["said"])
    return sorted((c, n, role, "\n".join(ts).strip(" ")) for c, n, role, ts in out)


def test_turns_are_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, i, rng.choice(transcripts.ROLES), rng.random() < 0.3, rng.choice(["", "x", " y ", "long line " * 500])) for c in range(30) for i in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "conv_id bigint, line_no bigint, role string, opens boolean, said string")
    want = brute_turns(df.collect(), "conv_id", "line_no")
    for block in (4, 1000):
        got = sorted((r["conv_id"], r["turn_line"], r["role"], r["text"]) for r in transcripts.turns(df, block=block).collect())
        assert got == want
    assert transcripts.turns(df.limit(0)).count() == 0


def test_url_list_history(spark):
    ev = [("host", "a.example.com", "add", "2024-01-10"), ("host", "a.example.com", "remove", "2024-02-10"), ("host", "a.example.com", "add", "2024-03-10"), ("domain", "Example.org", "add", "2024-01-01"), ("prefix", "b.example.net/x/y", "add", "2024-01-01"), ("prefix", "b.example.net/x/y", "add", "2024-01-05"), ("host", None, "add", "2024-01-01"), ("host", "z.com", "add", "2024-01-01"), ("host", "z.com", "remove", "2024-01-01")]
    events = spark.createDataFrame(ev, "kind string, entry string, action string, since string").withColumn("since", F.to_date("since"))
    cap = [(1, "http://a.example.com/", "2024-01-09", False), (2, "http://A.example.com./q?x", "2024-01-10", True), (3, "https://a.example.com:80/", "2024-02-10", False), (4, "http://u:p@a.example.com", "2024-04-01", True), (5, "http://deep.sub.example.org/", "2024-05-01", True), (6, "http://badexample.org/", "2024-05-01", False), (7, "http://b.example.net/x/y/z", "2024-05-01", True), (8, "http://b.example.net/x/yz", "2024-05-01", False), (9, None, "2024-05-01", False), (10, "http://a.example.com/", None, False), (11, "nonsense", "2024-05-01", False), (12, "http://z.com/", "2024-05-01", False)]
    captures = spark.createDataFrame([(*c, "clash", 1) for c in cap], "page_id bigint, url string, fetched_at string, want boolean, host string, n_active int").withColumn("fetched_at", F.to_date("fetched_at"))
    got = {r["page_id"]: r["blocked"] for r in url_filters.temporal_join(captures, events).collect()}
    assert got == {c[0]: c[3] for c in cap}
    assert not any(r["blocked"] for r in url_filters.temporal_join(captures, events.limit(0)).collect())
    assert url_filters.temporal_join(captures.limit(0), events).count() == 0
    assert url_filters.temporal_join(captures.unionByName(captures), events).count() == 24
