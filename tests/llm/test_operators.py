"""Operators of the llm subpackage against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgspark.llm import audio, chat, decontam, jaccard, langid, lines, packing, pii, secrets, urlgraph
from kgspark.llm._common import connected
from kgspark.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start int, label string, node long, key string, mask string, rank int"


def docs(spark, *texts):
    rows = [(k, t, "en", "s", None if t is None else len(t), 1, "x", 2, "k", "m", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Null, empty, white space, a very long text, ties, and a repeated row."""
    long = "word " * 60_000 + "\n" + "x" * 50_000
    d = docs(spark, None, "", " \n\t", long, "same text here for all of us", "same text here for all of us", "Ünï ✓ 😀 émoji")
    return d.union(d.where("doc_id in (0, 4)"))


def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_every_operator_takes_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "same text here for all of us"), (2, None), (2, ""), (None, "x")], "item_id long, text string")
    net = langid.Network(["de", "en"])
    stages = dict(corpus_pipeline.STAGES)
    for d in (odd(spark), docs(spark, "x").limit(0)):
        n = d.count()
        for out in (
            pii.digest(pii.detect(d)), secrets.digest(secrets.scan(d)), secrets.redact(d), langid.predict(d, net), lines.dedup(d), jaccard.join(d),
            decontam.digest(decontam.search(d, bench)), audio.digest(audio.featured(audio.media(d))),
        ):
            assert out.count() == n
        assert decontam.search(d, bench.limit(0)).where("n_hit > 0").count() == 0
        assert packing.pack(d, tokenizer_path()).select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() <= n, name
        assert stages["secrets"](spark, d, SF).count() == n
    assert langid.identify(docs(spark, "x").limit(0)).count() == 0


def test_pii_base_spans_match_plain_patterns(spark):
    random.seed(1)
    alphabet = "a.b@c-+ 0123456789().%"
    made = ["".join(random.choice(alphabet) for _ in range(120)) for _ in range(300)] + ["4111 1111 1111 1111", "a@b@c.de", "1.2.3.4.5.6.7.8", "999.1.1.1 10.0.0.1", "+49 (30) 123456-7", "0" * 45 + "1.2.3.4", "1.2.3." + "0" * 60]
    got = {r["doc_id"]: r for r in pii.digest(pii.detect(docs(spark, *made))).collect()}
    for k, t in enumerate(made):
        spans, sha = pii.brute(t)
        assert (got[k]["base_sha256"], [got[k][f"n_{x}"] for x in pii.BASE]) == (sha, [len(spans[x]) for x in pii.BASE]), t
    extra = pii.digest(pii.detect(docs(spark, "IBAN: DE89 3704 0044 0532 0130 00, see https://u:secret@h.example/x, 12 Main Street"))).head()["spans"]
    assert {x.split(":")[0] for x in extra.split(",")} >= {"account", "address"}
    assert pii.redact("a@b.cd x", [(0, 0, 6)]) == "<email> x"


def _secret_base(text):
    out = []
    patterns = ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")
    for rank, (kind, p) in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def _best_entropy(s):
    from collections import Counter
    from math import log2

    return max(-sum(c / 20 * log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19))


def test_secret_spans_and_entropy(spark):
    random.seed(2)
    word = lambda n, a: "".join(random.choice(a) for _ in range(n))
    made = [
        'password = "abc" token: secret=abcdefg', "secret=token:abcdefgh", "AKIA" + "B" * 16 + " AKIAX", "é password:hunter22 " + "0a" * 15, "x" + word(40, "0123456789abcdef"),
        word(44, secrets.ALPHABET), "ExampleKeyabcdefghij0123456789", *(word(60, "tokensecret:= '\"abcdef0123AKIA") for _ in range(150)),
    ]
    d = docs(spark, *made)
    for r in secrets.scan(d).collect():
        base = _secret_base(made[r["doc_id"]])
        assert [(x["start"], x["end"], x["kind"]) for x in r["found"] if x["kind"] in secrets.BASE] == [(s, e, k) for s, _, e, k in base]
        for x in r["found"]:
            assert made[r["doc_id"]][x["start"] : x["end"]] == x["value"]
    strings = [word(n, a) for n in (20, 21, 35, 64) for a in ("ab", "0123456789abcdef", secrets.ALPHABET)]
    got = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.best_entropy(F.col("s")).alias("h")).collect()
    assert all(abs(r["h"] - _best_entropy(r["s"])) < 1e-9 for r in got)
    clean = texts(secrets.redact(d))
    for r in secrets.scan(d).collect():
        out, at, text = [], 0, made[r["doc_id"]]
        for x in r["found"]:
            if x["start"] >= at:
                out += [text[at : x["start"]], "<SECRET>"]
            at = max(at, x["end"])
        assert clean[r["doc_id"]] == "".join([*out, text[at:]])
    many = " é ".join(f"token={k:08d}" for k in range(1500))
    assert texts(secrets.redact(docs(spark, many)))[0] == " é ".join(["<SECRET>"] * 1500)
    assert clean[3].startswith("é <SECRET>") and clean[6] == made[6]


def test_audio_payload_is_lossless_and_tensors_have_one_shape(spark):
    import pyarrow as pa

    made = ["", "a" * 64, "Grüße " * 700]
    m = {r["doc_id"]: r for r in audio.featured(audio.media(docs(spark, *made))).collect()}
    for k, t in enumerate(made):
        n, payload = audio.payload(t)
        assert n == len(t.encode()) and len(payload) % 64 == 0 and len(payload) >= 64 and audio.from_wav(bytes(m[k]["media"]))[1] == payload
        table = pa.ipc.open_stream(bytes(m[k]["features"])).read_all()
        assert table["log_mel"].type.shape == [audio.SLOTS, audio.MELS] and table.num_rows >= 1
    x = np.sin(np.arange(4000) * 0.05).astype(np.float32)
    y = audio.resample(x, 1, 2)
    assert len(y) == 2000 and abs(np.abs(y[100:-100]).max() - 1) < 0.05
    assert len(audio.resample(x, 3, 4)) == 3000
    level = np.array([0, 0, 0, 5, 5, 0.1, 5, -5, -5, 0])
    assert audio.segments(level, 1, -1) == [(3, 7)]
    got = audio.digest(audio.featured(audio.media(docs(spark, made[2], made[2])))).select("payload_sha256", "tail_crc32", "feature").distinct().collect()
    assert len(got) == 1 and got[0]["tail_crc32"] == zlib.crc32(audio.payload(made[2])[1][-64:])


def _plain_resample(x, up, down):
    h = audio._low_pass(up, down)
    full = np.zeros(len(x) * up)
    full[::up] = x
    late = len(h) // 2 // down
    return np.array([sum(h[k] * full[n * down - k] for k in range(len(h)) if 0 <= n * down - k < len(full)) for n in range(late, late - (-len(x) * up // down))])


def test_audio_features_against_plain_sums():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, 700).astype(np.float32)
    for up, down in ((1, 2), (3, 4), (2, 1), (1, 3)):
        assert np.abs(audio.resample(x, up, down) - _plain_resample(x, up, down)).max() < 1e-5
    mel, levels = audio.log_mel(x, 4000)
    padded = np.concatenate([x, np.zeros(256 + 5 * 128 - 700)])
    f = np.arange(129) * 4000 / 256
    to, back = lambda v: 2595 * np.log10(1 + v / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [back(to(40) + (to(2000) - to(40)) * k / 21) for k in range(22)]
    assert mel.shape == (6, 20)
    for k in range(6):
        frame = padded[128 * k : 128 * k + 256] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255))
        power = np.abs(np.array([(frame * np.exp(-2j * np.pi * q * np.arange(256) / 256)).sum() for q in range(129)])) ** 2
        for m in range(20):
            a, b, c = edges[m : m + 3]
            tri = np.clip(np.minimum((f - a) / (b - a), (c - f) / (c - b)), 0, None)
            assert abs(mel[k, m] - np.log((power * tri).sum() + 1e-6)) < 1e-2
        assert abs(levels[k] - 10 * np.log10((frame**2).sum() + 1e-6)) < 1e-3
    for _ in range(30):
        v, inside, want = rng.normal(0, 1, 60), False, []
        middle = np.median(v)
        for k, y in enumerate(v):
            if not inside and y >= middle + 0.3:
                inside, start = True, k
            elif inside and y < middle - 0.3:
                inside = False
                want.append((start, k))
        assert audio.segments(v) == want + ([(start, 60)] if inside else [])


def test_every_sample_counts(spark):
    made = ["Grüße " * 50 + "abc", "Grüße " * 50 + "abd", "x" * 766, "x" * 765 + "y"]
    got = [r["feature"] for r in audio.digest(audio.featured(audio.media(docs(spark, *made)))).orderBy("doc_id").collect()]
    assert got[0] != got[1] and got[2] != got[3]
    n = len(audio.payload(made[2])[1]) / 2 / 4000
    assert got[2].split(":")[1] == f"{n:.3f}"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.embed *= 0.3
    windows, mask, target = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.ones((4, 6), bool), np.array([0, 1, 2, 1])
    mask[1, 4:] = False
    loss, grads = net.gradients(windows, mask, target)
    for w, g in zip(net.weights(), grads, strict=True):
        where = np.argsort(-np.abs(g).ravel())[:4]
        for k in where:
            old, step = w.ravel()[k], 1e-2
            w.ravel()[k] = old + step
            up = net.gradients(windows, mask, target)[0]
            w.ravel()[k] = old - step
            down = net.gradients(windows, mask, target)[0]
            w.ravel()[k] = old
            assert abs((up - down) / (2 * step) - g.ravel()[k]) < 2e-3


def test_languages_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fitted(d)
    got = langid.predict(d, net, ("doc_id", "lang")).withColumn("h", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["h"]]
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert len(langid.positions(net, "für üns")) == len("für üns".encode())
    one = "für üns alle, " * 30 + "and then some"
    data, sums = one.encode(), np.zeros(len(net.langs))
    for at in range(0, len(data), langid.WINDOW):
        w = np.zeros((1, langid.WINDOW), np.uint8)
        w[0, : len(data[at : at + langid.WINDOW])] = list(data[at : at + langid.WINDOW])
        sums += net.label(w)[0, : len(data[at : at + langid.WINDOW])].sum(axis=0)
    r = langid.predict(docs(spark, one), net).head()
    assert r["lang_pred"] == net.langs[int(sums.argmax())] and abs(r["score"] - sums.max() / len(data)) < 1e-5
    rows = langid.sample(d, 16, 4)
    assert len(rows) <= 16 * 4 * len(net.langs) and max(len(w) for _, w in rows) == langid.WINDOW
    twice = langid.predict(docs(spark, one, one), net).select("lang_pred", "score").distinct().count()
    assert twice == 1 and langid.predict(docs(spark, "x"), langid.fitted(docs(spark))).head()["lang_pred"] == "und"
    none = langid.predict(docs(spark, None, "", "123 !", "x"), net).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in none][:3] == ["und"] * 3 and none[3]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in none)


EVENTS = "conv_id long, seq long, message_id string, op string, role string, text string, first int, rank int, chunk string"


def _events(spark, *rows):
    return spark.createDataFrame([(*r, 1, 2, "c") for r in rows], EVENTS)


def test_chat_fold_and_round_trip(spark):
    said = "\\### <|end|> \\<| <|"
    events = _events(
        spark, (1, 1, "a", "delta", "user", "Hel"), (1, 2, "a", "delta", "user", "lo" + said), (1, 3, "b", "delta", "assistant", "bad"), (1, 4, "b", "regenerate", "assistant", ""),
        (1, 5, "b", "delta", "assistant", "go"), (1, 6, "b", "delta", "assistant", "od" + said), (1, 7, "a", "edit", "user", "Hi"), (1, 8, "c", "delta", "user", "gone"), (1, 9, "c", "delete", "user", None),
        (None, None, "z", "delta", None, None),
    )
    out = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert out[1]["n_turns"] == 2 and out[1]["loss_chars"] == len("good" + said)
    assert out[1]["turns_sha256"] == hashlib.sha256(f"user\nHi\nassistant\ngood{said}\n".encode()).hexdigest()
    assert out[1]["loss_sha256"] == hashlib.sha256(f"good{said}".encode()).hexdigest()
    assert out[None]["n_turns"] == 1 and out[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.read_back(chat.render(chat.fold(events.limit(0)))).count() == 0
    stored = chat.render(chat.fold(events)).orderBy(F.rand(1))
    assert {r["conv_id"]: r for r in chat.read_back(chat.in_order(stored)).collect()} == out


def test_chat_repeated_events_ties_and_nulls(spark):
    rows = [
        (1, 2, "a", "edit", "user", "Hi"), (1, 2, "a", "edit", "user", "Hi"), (1, 1, "a", "delta", "user", "x"), (1, 3, "a", "delta", "user", "!"), (1, 3, "a", "delta", "user", "!"),
        (1, 1, None, "delta", "user", "same"), (1, 1, None, "delta", "user", "same"),
        (2, 5, "m", "delete", None, None), (2, 6, "m", "delta", "assistant", "back"), (2, 4, "m", "delta", None, "old"), (2, 6, "m", "regenerate", None, "re"),
        (3, None, "n", "unheard of", "user", "é" * 100_000), (3, None, "o", "delta", "user", ""),
    ]
    got = sorted((r["conv_id"], r["first"], r["message_id"] or "", r["role"], r["text"]) for r in chat.fold(_events(spark, *rows)).collect())
    assert got == [(1, 1, "", "user", "same"), (1, 1, "", "user", "same"), (1, 1, "a", "user", "Hi!"), (2, 4, "m", "assistant", "reback"), (3, None, "n", "user", "é" * 100_000), (3, None, "o", "user", "")]


def test_chat_against_a_plain_fold(spark):
    random.seed(12)
    rows = []
    for conv in range(20):
        for seq in range(random.randrange(60)):
            rows.append((conv, seq, f"m{random.randrange(6)}", random.choice(chat.OPS), random.choice(["user", "assistant"]), random.choice(["a", "<|", "\\", "öß "]) * random.randrange(3)))
    want: dict = {}
    for conv, _, m, op, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        now = want.setdefault(conv, {}).setdefault(m, [role, "", False])
        now[1:] = [("" if op != "delta" else now[1]) + ("" if op == "delete" else text), op != "delete"]
    random.shuffle(rows)
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(_events(spark, *rows)))).collect()}
    for conv, messages in want.items():
        live = [(r, t) for r, t, alive in messages.values() if alive]
        if live:
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in live).encode()).hexdigest()
            assert got[conv]["loss_sha256"] == hashlib.sha256("".join(t for r, t in live if r == "assistant").encode()).hexdigest()
        else:
            assert conv not in got


def _sets(t):
    w = [x.decode() for x in decontam.words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_against_all_pairs(spark):
    random.seed(4)
    base = [[random.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(random.randrange(40)) for _ in range(120)] for _ in range(6)]
    made = [None, "", "one two", "One, two!"]
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(random.randrange(4)):
                w[random.randrange(len(w))] = "new" + str(random.randrange(9999))
            made.append(" ".join(w))
        made.append(" ".join(b))
    s = list(map(_sets, made))
    linked = lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)
    want = {i: sum(linked(s[i], s[j]) for j in range(len(s)) if j != i) for i in range(len(s))}
    group = list(range(len(s)))
    for _ in s:
        group = [min([group[i], *(group[j] for j in range(len(s)) if linked(s[i], s[j]))]) for i in range(len(s))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join(docs(spark, *made)).collect()}
    assert got == {i: (group[i], want[i]) for i in range(len(s))}
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, *made)).collect()}
    assert kept == set(group)


def test_jaccard_tells_null_and_reused_ids_apart_by_text(spark):
    words = [f"word{k}" for k in range(60)]
    near = lambda k: " ".join([*words[:59], f"own{k}"])
    lone = lambda c: " ".join(f"{c}{k}" for k in range(30))
    # Null ids on near copies; id 2 on a near copy and on a text of its own; a class without ids.
    made = [(None, near(0)), (None, near(1)), (1, near(2)), (2, near(3)), (2, lone("x")), (None, lone("y")), (None, lone("y") + " z")]
    d = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in jaccard.join(d).collect())
    assert got == sorted([(0, 1, 3), (0, 1, 3), (1, 1, 3), (2, 1, 3), (2, 2, 0), (0, 0, 1), (0, 0, 1)])
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(d).collect()]
    assert len(kept) == 3 and {(1, near(2)), (2, lone("x"))} < set(kept) and sum(t.startswith("y0") for _, t in kept) == 1


def test_keep_one_keeps_one_row_of_each_class(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, b), (5, a), (5, b), (7, a), (7, a), (None, a), (8, None), (8, None), (9, "..."), (9, "...")]
    kept = sorted((r["doc_id"], r["text"] or "") for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [(1, b), (5, a), (8, ""), (8, ""), (9, "..."), (9, "...")]
    none = [(None, a), (None, a), (None, b)]
    assert jaccard.keep_one(spark.createDataFrame(none, "doc_id long, text string")).count() == 2


def test_units_of_a_chain_follow_its_length(spark):
    words = [f"w{random.Random(k).randrange(10**9)}" for k in range(4 * 700 + 120)]
    moved = []
    for n in (350, 700):
        d = spark.createDataFrame([(k, " ".join(words[4 * k : 4 * k + 120])) for k in range(n)], "doc_id long, text string")
        signed = jaccard.signatures(d.withColumn("key", F.col("doc_id")), *jaccard.banding())
        moved.append(jaccard.units_of(signed.select("node", F.explode("bands").alias("h"))).count())
    assert moved[1] < 2.5 * moved[0] and moved[1] < 6 * 700
    got = jaccard.join(d).collect()
    # Each text shares enough with the three next to it on either side.
    assert {r["class_id"] for r in got} == {0} and sorted(r["n_links"] for r in got) == sorted([3, 4, 5] * 2 + [6] * (n - 6))


def test_blocks_of_a_component_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    test_jaccard_against_all_pairs(spark)


def test_banding_reaches_its_recall():
    bands, rows = jaccard.banding(0.8, 0.999, 200)
    assert bands * rows <= 200 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_components_of_random_edges(spark):
    random.seed(1)
    e = [(random.randrange(120), random.randrange(120)) for _ in range(80)] + [(k, 119) for k in range(90, 119)] + [(None, 3)]
    label = list(range(120))
    for _ in range(120):
        for a, b in e[:-1]:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(v == label[k] for k, v in got.items()) and set(got) == {x for a, b in e[:-1] if a != b for x in (a, b)}


def test_urls_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [
        (1, "http://A.com/x?y", link("b.org", "b.org", "c.org")), (2, "http://b.org/p#q", link("d.org")), (3, "http://bad.net/es/1", None), (4, "http://spam.org/", link("bad.net")), (5, "http://www.example.com/en/1", ""),
        (6, "http://x.example.com/en/1", ""), (7, None, None), (8, "nothing", ""), (9, "http://d.org", ""), (10, "http://bad.net/en/", ""), (11, "http://notexample.com", ""),
    ]
    got = {r["page_id"]: r for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.com", "/x", "com/", "allow")
    assert [got[k]["verdict"] for k in (2, 3, 4, 5, 6, 7, 8, 9, 10)] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "block"]
    assert got[6]["rule"] == "example.com/en/" and got[11]["rule"] is None and got[7]["host"] == got[8]["path"] == ""


PAGES = "page_id long, url string, html string, part int, spread string, rule int"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], PAGES)


def test_urls_follow_a_chain_to_its_end(spark):
    link = lambda h: f'<a href="http://{h}/">'
    rows = [(k, f"http://h{k}.org/", link(f"h{k + 1}.org") if k < 29 else link("bad.net")) for k in range(30)] + [(99, "http://bad.net/es/", None)]
    got = {r["page_id"]: r["verdict"] for r in urlgraph.judge(_pages(spark, rows)).collect()}
    assert set(got.values()) == {"block"} and len(got) == 31


def test_urls_against_plain_power_iteration(spark):
    rnd = random.Random(5)
    hosts = [f"h{k}.org" for k in range(25)] + ["good.com", "fine.com", "bad.net"]
    rows = [(k, f"http://{h}/{'es/' if h == 'bad.net' else ''}", "".join(f'<a href="//{rnd.choice(hosts)}/x">' for _ in range(rnd.randrange(5)))) for k, h in enumerate(hosts)]
    rows += [rows[3], (100, None, "<a href=http://h1.org>"), (101, "", None)]
    n = {h: k for k, h in enumerate(hosts)}
    w = np.zeros((len(hosts),) * 2)
    for _, url, html in rows:
        if url:
            for to in re.findall(r'href="//([^/]+)/', html):
                if n[to] != n[url.split("/")[2]]:
                    w[n[url.split("/")[2]], n[to]] += 1
    good, bad = np.array([h.endswith(".com") for h in hosts], float), np.array([h.endswith(".net") for h in hosts], float)
    def walk(m, seed):
        out = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        x = t = 0.15 * seed / seed.sum()
        for _ in range(400):
            t = 0.85 * t @ out
            x = x + t
        return x
    trust, distrust = walk(w, good), walk(w.T, bad)
    scores = {r["host"]: r for r in urlgraph.host_scores(urlgraph.ruled(_pages(spark, rows)), urlgraph.links(_pages(spark, rows))).collect()}
    for h, k in n.items():
        got = scores[h] if h in scores else {"trust": 0, "distrust": 0}
        assert abs(got["trust"] - trust[k]) < 1e-5 and abs(got["distrust"] - distrust[k]) < 1e-5
    verdict = {r["page_id"]: r["verdict"] for r in urlgraph.judge(_pages(spark, rows)).collect()}
    for h, k in n.items():
        if h.endswith(".org") and abs(distrust[k] - trust[k]) > 1e-5:
            assert verdict[k] == ("block" if distrust[k] > trust[k] else "allow")
    assert urlgraph.judge(_pages(spark, rows)).count() == len(rows) and urlgraph.judge(_pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [10**6, 300])
def test_decontamination_against_all_windows(spark, blocks):
    random.seed(6)
    pick = lambda n: " ".join(random.choice("the of and a to in is Ünï x1".split()) for _ in range(n))
    items = {1: pick(14), 2: "The OF", 3: pick(10), 4: "", 5: pick(25)}
    made = [pick(200) + " " + items[1] + ". " + pick(20), "THE of", items[5].upper() + "!", None, "", items[3][:-1]] + [pick(400) for _ in range(5)]
    bench = spark.createDataFrame([*items.items(), (1, items[1])], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.search(docs(spark, *made), bench, blocks).collect()}
    void = decontam.search(docs(spark, made[0]), bench.withColumn("item_id", F.lit(None).cast("long")), blocks).head()
    assert (void["n_hit"], void["n_items"], void["items"]) == (got[0][1], 1, [])
    assert got == {k: decontam.brute(t, items) for k, t in enumerate(made)}
    sha = decontam.digest(decontam.search(docs(spark, items[1]), bench)).head()["items_sha256"]
    assert sha == decontam.items_sha256(decontam.brute(items[1], items)[2])


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    made = [r["text"] for r in corpus(spark).collect()] + [None, "", "a\x1cb", "İSTANBUL ΑΣ. Σ", "x<|endoftext|>y", "don't it'S", "é Å.,", "word " * 5000]
    d = docs(spark, *made)
    got = packing.pack(d, tokenizer_path()).collect()
    want = set()
    for k, x in enumerate(made):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want |= {(k, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)}
    assert want == {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} and len(want) == len(got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        ends = [o + n for o, n in sorted(v)]
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_plan_places_every_rank_once():
    random.seed(8)
    for _ in range(20):
        h = {random.randrange(1, 101): random.randrange(1, 400) for _ in range(25)}
        room, seen = {}, {}
        for length, rank, n, first, offset in packing.plan(h, 100):
            for k in range(n):
                assert room.get(first + k, 0) == offset
                room[first + k] = offset + length
                seen.setdefault(length, []).append(rank + k)
        assert all(sorted(seen[x]) == list(range(c)) for x, c in h.items()) and max(room.values()) <= 100


def _say(rnd, n):
    return [f"{rnd.choice(['lorem', 'ipsum', 'dolor', 'amet', 'elit'])}{rnd.randrange(10**9)}" for _ in range(n)]


def _spans_agree(made, got):
    for r in got.values():
        spans = [tuple(map(int, x.split(":"))) for x in r["removed_spans"].split(",") if x]
        assert sum(b - a for a, b in spans) == r["removed_chars"] and len(spans) == r["n_removed"]
        text, at, out = made[r["doc_id"]], 0, []
        for a, b in spans:
            out.append(text[at:a])
            at = b + (text[b : b + 1] == "\n")
        assert "".join([*out, text[at:]]) == r["text"]


def test_lines_keep_the_first_and_leave_sentences_alone(spark):
    rnd = random.Random(9)
    say = lambda n: " ".join(_say(rnd, n))
    line, sentence = say(9), say(15) + "."
    made = [f"{line}\n{say(12)}", f"{say(12)}\n{line.upper()}\n{line}", f"{say(8)}. {sentence} {say(5)}", f"{say(7)}. {sentence} {say(6)}", say(60), "Yes it is.\nYes it is.", "Yes it is."]
    got = {r["doc_id"]: r for r in lines.dedup(docs(spark, *made)).collect()}
    assert got[1]["text"].strip() == made[1].split("\n")[0] and got[1]["keep_docs"] == [0] and (got[1]["n_lines"], got[1]["n_passages"]) == (2, 0)
    assert all(got[k]["text"] == made[k] for k in (0, 2, 3, 4, 5, 6))
    _spans_agree(dict(enumerate(made)), got)


def test_lines_catch_passages_mid_sentence_and_rewrapped(spark):
    rnd = random.Random(21)
    say = lambda n: _say(rnd, n)
    made, shared = [], []
    for k in range(60):
        w = say(51 + k % 10)
        for at in range(25, len(w), rnd.randrange(12, 40)):
            w[at] += "."
        wrap, own = 8 + k % 17, say(6)
        there = own + w + say(6)
        other = "\n".join(" ".join(there[i : i + wrap]) for i in range(0, len(there), wrap)) if k % 2 else " ".join(say(30 + k % 7) + w + say(9))
        made += [" ".join(say(k % 7) + w + say(5)), other]
        shared.append(set(w))
    # The last words of one sentence and the first of the next, with up to 6 own words beside them.
    w = say(26)
    w[-1] += "."
    w += say(26)
    made += [" ".join(say(6) + w + say(6)), " ".join(say(4) + w + say(5))]
    shared.append(set(w))
    got = {r["doc_id"]: r for r in lines.dedup(docs(spark, *made)).collect()}
    gone = []
    for k, w in enumerate(shared):
        assert got[2 * k]["text"] == made[2 * k]
        left = set(got[2 * k + 1]["text"].split())
        gone.append(len(w - left))
        assert set(made[2 * k + 1].split()) - w <= left and got[2 * k + 1]["keep_docs"] in ([2 * k], [])
    assert sum(g > 0 for g in gone) >= 0.95 * len(gone) and sum(gone) >= 0.5 * sum(map(len, shared))
    _spans_agree(dict(enumerate(made)), got)


def test_passages_end_at_whole_sentences_where_they_hold_any(spark):
    rnd = random.Random(4)
    sentences = [" ".join(_say(rnd, 11)) + "." for _ in range(9)]
    made = [" ".join(sentences), " ".join(_say(rnd, 9)) + " " + " ".join(sentences) + " " + " ".join(_say(rnd, 9))]
    got = {r["doc_id"]: r for r in lines.dedup(docs(spark, *made)).collect()}
    (span,) = got[1]["removed_spans"].split(",")
    a, b = map(int, span.split(":"))
    assert made[1][b - 1] == "." and made[1][a:b] in made[0] and made[1][a - 2] in ". " and b - a > 500
    assert made[1][a:b].split(". ")[0] + "." in sentences


def test_lines_tell_null_and_reused_ids_apart_by_text(spark):
    line = "this is the one line that both texts of the pair share"
    made = [(None, f"{line}\nfirst of the texts without an id"), (None, f"{line}\nsecond of the texts without an id")]
    for rows in (made, [(7, t) for _, t in made]):
        got = [r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        by_key = sorted(got, key=lambda r: lines.text_key(dict((u.split("\n")[-1], u) for _, u in rows)[r["text"].split("\n")[-1]]))
        assert [line in r["text"] for r in by_key] == [True, False]
        assert [r["n_removed"] for r in by_key] == [0, 1]


def test_whole_lines_against_a_plain_fold(spark):
    """Lines of 5 to 14 words in new orders, so that no passage repeats: what goes is told by the lines' texts alone."""
    rnd = random.Random(31)
    pool = [" ".join(_say(rnd, rnd.randrange(2, 15))) for _ in range(400)]
    made = {}
    for k in range(150):
        each = [" ".join(_say(rnd, 9)) if rnd.random() < 0.6 else rnd.choice(pool) for _ in range(rnd.randrange(1, 12))]
        made[k] = "\n".join(x if i % 2 else f" {x.title()}  " for i, x in enumerate(each))
    seen, want = set(), {}
    for k, t in made.items():
        out = []
        for x in t.split("\n"):
            name = " ".join(x.lower().split())
            if len(name.split()) < 5 or name not in seen:
                out.append(name)
            seen.add(name)
        want[k] = out
    got = {r["doc_id"]: r for r in lines.dedup(docs(spark, *made.values())).collect()}
    assert {k: [" ".join(x.lower().split()) for x in r["text"].split("\n") if x.strip()] for k, r in got.items()} == {k: [x for x in v if x] for k, v in want.items()}
    _spans_agree(made, got)


def test_no_long_repeat_is_left_in_the_corpus_and_short_ones_stay(spark):
    """All windows of 60 words of what is left, by their texts, are told apart; what went stood in an earlier document."""
    d = corpus(spark)
    before, rows = texts(d), {r["doc_id"]: r for r in lines.dedup(d).collect()}
    seen, again, earlier = set(), 0, {}
    for k in sorted(rows):
        w = rows[k]["text"].lower().split()
        mine = {" ".join(w[i : i + 60]) for i in range(len(w) - 59)}
        again += len(mine & seen)
        seen |= mine
        kept = " ".join(before[k].lower().split())
        for a, b in (map(int, x.split(":")) for x in rows[k]["removed_spans"].split(",") if x):
            for part in before[k][a:b].split("\n"):
                some = " ".join(part.lower().split()[:5])
                assert not some or some in earlier.setdefault("all", "") or kept.count(some) > 1
        earlier["all"] = earlier.get("all", "") + "\n" + kept
    assert again == 0


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    d = corpus(spark)
    got = corpus_pipeline.run(spark, SF).collect()
    net = langid.fitted(d)
    ok = {r["doc_id"] for r in langid.predict(d, net).where("lang_pred <> 'und' and score >= 0.3").collect()}
    by_id = {k: t for k, t in texts(d).items() if k in ok}
    s = {k: _sets(t) for k, t in by_id.items()}
    first = dict.fromkeys(s)
    order = sorted(s)
    group = {k: k for k in order}
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    for _ in order:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    keep = {k for k in order if group[k] == k and not decontam.brute(by_id[k], items)[1]}
    assert first is not None and {r["doc_id"] for r in got} == keep
    left = d.where(F.col("doc_id").isin(*keep))
    want = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pieces(secrets.redact(left), tokenizer_path()).collect()}
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in got} == want


def test_query_names():
    assert [sum(n.startswith(f"op{k}_") for n in queries()) for k in range(1, 11)] == [1] * 10
