"""Each operator against a brute-force version and on odd rows: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from bitempo.llm import chat_format, jaccard_join, line_dedup, mixing, packing, pii, quality_rules, substring_dedup, topk_search, toxicity
from bitempo.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, sig long, node long, n int, key string, site string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
A = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees above"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, A, "en", "a"), (2, A, "en", "b"), (2, A, "en", "b"), (3, None, None, None), (4, "", "en", "a"), (None, A, "en", "a"), (None, None, None, None),
        (5, LONG, "en", "c"), (6, LONG + " tail", "en", None), (7, A + " end", "xx", "c"), (8, "   \n\t ", "en", "a"), (9, "one two", "en", "a"), (10, "ONE two", "en", "a"),
        (11, "é̈ 漢字 " * 40, "zz", "d"), (12, "a" * 60_000, "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "w", 1, 2, 3, "k", "s") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_chat(spark):
    rows = [(1, 0, "user", chat_format.PLANTED), (1, 1, "assistant", "\\b <s> ok"), (2, 0, None, None), (2, 0, "tool]", "x"), (None, 3, "assistant", ""), (2, 0, "tool]", "x")]
    made = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(made) == {1, 2, None}
    assert made[1]["loss_sha256"] == hashlib.sha256(b"\\b <s> ok").hexdigest() and not made[1]["rewrites_history"]
    assert made[2]["turns_sha256"] == hashlib.sha256(b"\n\ntool]\nx\ntool]\nx\n").hexdigest() and made[2]["n_turns"] == 3
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_finds_rewritten_history(spark):
    def only_last(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "u", "hello"), (1, 1, "a", "there"), (2, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["rewrites_history"] for r in chat_format.format_chats(df, only_last).collect()} == {1: True, 2: False}


def test_chat_places_after_rewriting(spark):
    def latest_first(turns):
        return "".join(f"<{r}>{t};" for r, t in reversed(turns[-2:]))

    rows = [(1, 0, "u", "hello"), (1, 1, "a", "there"), (1, 2, "u", "again")]
    (r,) = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), latest_first).collect()
    assert r["rewrites_history"] and [r["formatted"][a:b] for a, b in zip(r["text_starts"], r["text_ends"])] == ["", "there", "again"]


def test_chat_long_text_and_clashing_columns(spark):
    long = "[INST] <s> \\ " * 20_000
    rows = [(1, 0, "user", long, "x", 1, "y"), (1, 1, "assistant", long, "x", 1, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, n_turns int, loss string")
    (r,) = chat_format.digests(chat_format.format_chats(df)).collect()
    assert r["loss_chars"] == len(long) and r["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and r["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\l<[", "a\\b]c", chat_format.PLANTED])
def test_escape_round_trip(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not set("<[") & set(chat_format.escape(text))


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if all(comp[comp[i]] == comp[i] for i in comp):
            break
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent", "chunk"), [(4, 85, 200), (5, 80, 2)])
def test_jaccard(spark, docs, width, percent, chunk):
    near = docs.where("doc_id < 40")
    changed = near.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.regexp_replace("text", "(?<=^.{60})[a-z]+ ", ""))
    both = near.unionByName(changed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(both, width, percent, chunk).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in both.collect()], width, percent)


def test_jaccard_parts_lose_no_link():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        rule = jaccard_join.Rule(percent)
        for n in (1, 2, 5, 6, 7, 13, 20, 21, 64, 129, 500, 1023):
            for _ in range(30):
                s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                drop = rng.integers(0, rule.differ(2 * n) + 1)
                t = np.unique(np.concatenate([s[rng.permutation(len(s))[drop // 2 :]], rng.integers(0, 2**63, drop - drop // 2).astype(np.uint64)]))
                shared = len(np.intersect1d(s, t))
                if len(t) and rule.links(len(s), len(t), shared) and shared < max(len(s), len(t)):
                    assert set(jaccard_join.part_sums(s, rule)) & set(jaccard_join.part_sums(t, rule))


def test_jaccard_odd(odd, none):
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(odd).collect())
    assert got[2, 1] == 2 and got[6, 5] == 1 and got[7, 1] == 1 and got[10, 9] == 1 and got[None, None] == 2
    assert all(got[i, i] == 1 for i in (1, 3, 4, 5, 8, 9, 11, 12))
    assert jaccard_join.jaccard_components(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (60, 50), (70, 71), (5, 5)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40, 70: 70, 71: 70}


def brute_quality(rows, trusted_ids):
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score), by plain loops."""

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def grams(ws):
        ones = [xxhash.xxh64_intdigest(w.encode(), 42) for w in ws]
        return [signed(h) % quality_rules.BUCKETS for h in ones] + [signed(xxhash.xxh64_intdigest(w.encode(), h)) % quality_rules.BUCKETS for h, w in zip(ones, ws[1:])]

    split = [(i, t or "", [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    raw, target = Counter(), Counter()
    for i, _, ws in split:
        found = Counter(grams(ws))
        raw.update(found)
        if i in trusted_ids:
            target.update(found)
    all_raw, all_target, prior = sum(raw.values()), sum(target.values()), quality_rules.PRIOR * quality_rules.BUCKETS
    weight = {b: math.log((target[b] + prior * (n / all_raw)) / (all_target + prior) / (n / all_raw)) for b, n in raw.items()}
    out = {}
    for i, t, ws in split:
        windows = Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        repeats = len({p for k in range(len(ws) - 2) if windows[tuple(ws[k : k + 3])] > 1 for p in (k, k + 1, k + 2)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = grams(ws)
        out[i] = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats, len(ws) < 50 or 100 * repeats > 50 * len(ws), sum(weight[b] for b in g) / len(g) if g else 0.0)
    return out


def test_quality(odd, none, labels, docs):
    trusted = labels.where("quality = 1").select("doc_id")
    want = brute_quality([(r["doc_id"], r["text"]) for r in docs.collect()], {r["doc_id"] for r in trusted.collect()})
    for r in quality_rules.quality_scores(docs, trusted).collect():
        told = want[r["_bt_row"]["doc_id"]]
        assert tuple(r[c] for c in quality_rules.ADDED[:6]) == told[:6] and r["score"] == pytest.approx(told[6], abs=2e-6)
        assert r["kept"] == (not told[5] and told[6] >= quality_rules.THRESHOLD) or abs(told[6] - quality_rules.THRESHOLD) < 1e-5
    got = {r["_bt_row"]["doc_id"]: r for r in quality_rules.quality_scores(odd, labels.select("doc_id")).collect()}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and got[9]["n_words"] == 2 and got[11]["n_repeat_words"] == 80 and got[11]["base_failed"]
    clash = odd.withColumn("w", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("good", F.lit(0)).withColumn("ws", F.lit("y"))
    assert sorted(r["score"] for r in quality_rules.quality_scores(clash, labels.select("doc_id")).collect()) == sorted(r["score"] for r in quality_rules.quality_scores(odd, labels.select("doc_id")).collect())
    assert quality_rules.quality_scores(none, labels.select("doc_id")).count() == 0
    assert quality_rules.quality_scores(docs, labels.where("false").select("doc_id")).where("NOT base_failed AND NOT kept").count() == 0


def test_quality_of_rows_held_out(spark):
    """Weights learned without them part the good and the bad of the rows that are held out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    made = quality_rules.quality_scores(docs, labels.where("quality = 1").where(~held).select("doc_id")).where("NOT base_failed")
    told = made.select(F.col("_bt_row.doc_id").alias("doc_id"), "kept").join(labels.where(held), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    got = {r["quality"]: r["kept"] for r in told.collect()}
    assert got[1] >= 0.99 and got[0] <= 0.1


def brute_pii(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] * (16 <= len(d) <= 19 and luhn(d))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(spark, docs, odd, none):
    hard = ["a@b.c%d@e.f x@y@z.com 😀 é me@x.io.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.99999999999", "+1 (262) 555-3752 +12 4470-3207 9887 8305 9 4703207988783059", "9" * 5000 + " " + "a." * 4000, "iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789", "", None, "4264720996315236-4264720996315236", "é 1.2.3.4 a@b.co " * 1000]
    rows = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in pii.find_pii(rows).collect():
        assert [(pii.KINDS[x["k"]], x["start"], x["end"]) for x in r["_bt_pii"] if x["k"] < 4] == brute_pii(r["_bt_row"]["text"] or "")
        if r["_bt_row"]["doc_id"] == 1004:
            assert {pii.KINDS[x["k"]] for x in r["_bt_pii"]} >= {"iban", "ssn"}
    assert pii.find_pii(none).count() == 0 and pii.find_pii(odd).count() == odd.count()


def test_pii_counts_of_the_query(spark, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.op4_pii(spark, SF).collect():
        want = brute_pii(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_pii_context_decides(spark):
    key, iban = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "DE89370400440532013000"
    cases = {f'token = "{key}"': ["secret"], f"digest {key} of it": [], f"pay {iban} now": ["iban"], f"invoice {iban}": [], f"invoice to bank account {iban}": ["iban"], "ssn 123-45-6789": ["ssn"], "123-45-6789 is a number": [],
             "SSN 666-45-6789": [], "DE88370400440532013000": [], f"secret {'x' * 50}": [], "write to me@x.io": ["email"], f"é token: {key[:20]}, password: {key[20:]}z and none": ["secret", "secret"]}
    rows = spark.createDataFrame([(t, "kept", 1) for t in cases] * 2, "text string, pii string, _bt_k int")
    for r in pii.find_pii(rows).collect():
        assert r["_bt_row"]["pii"] == "kept"
        text = r["_bt_row"]["text"]
        assert [pii.KINDS[x["k"]] for x in r["_bt_pii"]] == cases[text], text
        for x in r["_bt_pii"]:
            assert text[x["start"] : x["end"]].replace("z", "").strip() and " " not in text[x["start"] : x["end"]].strip() and 60 <= x["score"] <= 100


def test_lines(spark, odd, none):
    line = "this line stands on many many sites"
    rows = [(i, f"{line}\nown text of document number {i}", f"s{i}") for i in range(15)] + [(20, line, None), (None, line, "s1")]
    made = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert made[0].startswith(line) and made[None] == "" and made[20] == "" and all(line not in made[i] for i in range(1, 15))
    assert line_dedup.cleaned(odd).count() == odd.count() and line_dedup.cleaned(odd).columns == odd.columns and line_dedup.cleaned(none).count() == 0


def made_all(known, told):
    return toxicity.toxicity(known, told).where("doc_id >= 300").agg(F.sum("score")).first()[0]


def test_toxicity_of_rows_held_out(spark):
    known, told = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.toxicity(known, told).join(told, "doc_id").where("held_out").toPandas()
    said, toxic = held.score >= toxicity.THRESHOLD, held.toxic == 1
    assert (said & toxic).sum() >= 0.9 * toxic.sum() and (said & toxic).sum() >= 0.9 * said.sum()


def test_channel_finds_what_plain_words_do_not(spark):
    known, told = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.char_model(known)
    weight = toxicity.feature_weights(known.join(told, "doc_id").select("text", F.col("toxic")), model)
    with_, without = toxicity.Reader(model, weight), toxicity.Reader(model, weight, channel=False)
    hidden = ["the 1d10t of the and", "and 5tup!d ones", "the l.o.s.e.r and", "it is tr@$h", "the m o r o n is", "stuuuuuupid of the", "cl0wn", "!" + "i.d.i.o.t" * 5, "1d107", "p@7h371c", "wor" + "r" * 60 + "thless"]
    for text in hidden:
        assert with_.evidence(text)[0] > 3 > without.evidence(text)[0], text
    for text in ["plain 1999 and 3.14, 12:30", "a - b / c 555-1234", "e.g. the U.S. of", "9" * 5000]:
        assert with_.evidence(text)[0] == without.evidence(text)[0], text


def test_toxicity(spark, docs, labels, odd, none):
    model = toxicity.char_model(docs)
    assert toxicity.restored("plain,", model) == ("plain",)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    made = toxicity.toxicity(known, told).join(told, "doc_id").toPandas()
    held = made[made.held_out]
    assert ((held.score >= toxicity.THRESHOLD) == (held.toxic == 1)).mean() > 0.9
    twice = toxicity.toxicity(known.unionByName(known.where("doc_id < 300")), told)  # repeated rows change no weight
    assert twice.where("doc_id >= 300").agg(F.sum("score")).first()[0] == pytest.approx(made_all(known, told), rel=1e-6)
    got = toxicity.toxicity(odd, told).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(none, told).count() == 0


def test_deobfuscation(spark):
    model = toxicity.char_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert toxicity.decode("1d10t", model) == "idiot" and toxicity.decode("stuuuupid", model) == "stupid"
    assert toxicity.decode("i d i o t", model, spaced=True).replace(" ", "") == "idiot"


def check_packing(made, capacity=2048):
    for _, g in made.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]])).all() and g.length.sum() <= capacity


def test_packing(docs, odd, none):
    made = packing.pack_documents(docs, with_ids=True).toPandas()
    check_packing(made)
    assert made.sequence_id.nunique() <= math.ceil(made.length.sum() / 2048) + 2
    tokenizer = packing._tokenizer(packing.VOCABULARY)[0]
    for r in docs.collect():
        ids = [x for p in made[made.doc_id == r["doc_id"]].sort_values("piece").ids for x in p]
        assert ids == [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
    check_packing(packing.pack_documents(odd).toPandas())
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("counts", [{}, {2048: 5}, {1: 5000}, {1025: 7}, {1500: 10, 548: 9, 3: 4}, {n: n % 7 + 1 for n in range(1, 2048, 13)}, {1: 3, 2: 10**9, 2047: 10**6}])
def test_pack_holds_each_piece_once(counts):
    held = Counter()
    for content, many in packing.pack(counts):
        assert sum(content) <= 2048
        for n in content:
            held[n] += many
    assert held == Counter(counts)


def lengths_of(spark, sf, path="/root/testdata"):
    return {r["length"]: r["n"] for r in packing.token_pieces(spark.read.parquet(f"{path}/{sf}/documents.parquet")).groupBy("length").agg(F.count("*").alias("n")).collect()}


def sequences(groups):
    return sum(many for _, many in groups)


def test_columns_make_the_packing(spark):
    counts = lengths_of(spark, "sf0.1")
    short = {n: k for n, k in counts.items() if n < 2048}
    bound = math.ceil(sum(n * k for n, k in counts.items()) / 2048)
    columns = sequences(packing.rounded(short))
    made = sequences(packing.pack(counts))
    assert columns >= 0.95 * (made - counts[2048]) and made <= 1.001 * bound
    _, x, dual = packing.fractional(short, 2048)
    assert dual <= made - counts[2048] and sum(x.values()) <= 1.1 * dual


@pytest.mark.parametrize("many", [1, 50])
def test_columns_beat_best_fit(many):
    counts = {n: k * many for n, k in ((1030, 6), (524, 6), (518, 6), (500, 12))}
    assert sequences(packing.rounded(counts)) == sequences(packing.pack(counts)) == 9 * many
    assert sequences(packing.best_fit(counts, 2048)) == 11 * many


def test_fractional_solution_covers_every_row():
    counts = {1500: 10, 548: 9, 700: 30, 3: 4, 1: 1}
    lengths, x, dual = packing.fractional(counts, 2048)
    cover = Counter()
    for column, amount in x.items():
        assert sum(int(lengths[k]) * n for k, n in column) <= 2048
        for k, n in column:
            cover[int(lengths[k])] += n * amount
    assert all(cover[n] >= k - 1e-6 for n, k in counts.items()) and dual <= sum(x.values()) + 1e-6


def test_tokens_as_the_library_gives_them():
    texts = ["don't, DON'T. x'', a.b., 'S 's. I'll! (x) [y], 12.5% ### \x01a. <|endoftext|>. A<|endoftext|>, <|ENDOFTEXT|>!", "Ça va\xa0bien oui 123 ½² é ́x ​", "\x1c a\x1fb \x85 c", "ΑΣ ΣΑΣ. İx ẞ", ""]
    rng = np.random.default_rng(9)
    texts += ["".join(rng.choice(list("aAzZ09'sStTmMdDlLrReEvV.,;!?<|>_-\"()#&*\\/\x01\x7f éÉßñ漢 \n"), rng.integers(1, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice(["don't", "DON'T", "'S", "<|endoftext|>", "<|", "|>", "A", "b", ".", "'", " ", "...", "9"], rng.integers(1, 9))) for _ in range(4000)]
    rng = np.random.default_rng(9)
    texts += ["".join(rng.choice(list("aAzZ09'sStTmMdDlLrReEvV.,;!?<|>_-\"()#&*\\/\x01\x7f éÉßñ漢 \n"), rng.integers(1, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice(["don't", "DON'T", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "A", "b", ".", "'", " ", "...", "9"], rng.integers(1, 9))) for _ in range(4000)]
    tokenizer = packing._tokenizer(packing.VOCABULARY)[0]
    texts += [" leading and trailing \t", "\x0b\x0c\r\n"]
    assert [x.tolist() for x in packing.encode(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.encode(pa.array([None, "a", None]).slice(1))] == [tokenizer.encode("a").ids, []]


def test_mixing(spark, docs, odd, none):
    made = mixing.mix(docs).select("_bt_row.doc_id", "_bt_row.source", "_bt_pass", "_bt_tokens", "_bt_weight").toPandas()
    assert set(made.doc_id) == {r["doc_id"] for r in docs.collect()} and not made.duplicated(["doc_id", "_bt_pass"]).any()
    size = made[made._bt_pass == 0].groupby("source")._bt_tokens.sum()
    weight = made.groupby("source")._bt_weight.first()
    budget = (size / weight).max()
    got = made.groupby("source")._bt_tokens.sum()
    longest = made.groupby("source")._bt_tokens.max()
    assert ((got - weight * budget).abs() <= longest + 1).all() and (got / size).max() <= mixing.MAX_PASSES + (longest / size).max()
    tokens = {"a": 700, "b": 200, "c": 100}
    w = mixing.tempered(tokens, mixing.exponent(tokens, target_entropy=1.0))
    assert abs(mixing.entropy(w) - 1.0) < 1e-9
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() >= odd.count() and mixing.mixed(none).count() == 0


def brute_mixing(rows):
    """(source, doc_id, pass) of the mixture, by plain loops: quotas from the weights, rows in the order of their hash until the quota is met."""
    size = Counter()
    for _, source, n in rows:
        size[source] += n
    total, limit = sum(size.values()), mixing.MAX_PASSES

    def most(a):
        w = {s: (n / total) ** a for s, n in size.items()}
        z = sum(w.values())
        budget = max(n * z / w[s] for s, n in size.items())
        return {s: max(1.0, w[s] / z * budget / n) for s, n in size.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if max(most(mid).values()) <= limit else (mid, high)
    return most(high), size


def test_mixing_quotas(spark):
    rows = [(i, "abcde"[min(4, i // 400)], " ".join(["x"] * (i % 7 + 1))) for i in range(1700)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).select("_bt_row.doc_id", "_bt_row.source", "_bt_pass", "_bt_block", "_bt_key", "_bt_tokens").toPandas()
    want, size = brute_mixing([(i, s, i % 7 + 1) for i, s, _ in rows])
    for s, p in want.items():
        mine = made[made.source == s]
        quota = p * size[s]
        got = mine._bt_tokens.sum()
        assert quota - 1 <= got <= quota + 7, (s, quota, got)  # the row that reaches the quota is the last one
        last = mine[mine._bt_pass == 1].sort_values(["_bt_block", "_bt_key"])
        once = mine[mine._bt_pass == 0]
        assert len(once) == sum(r[1] == s for r in rows) and set(last.doc_id) <= set(once.doc_id)
        assert not len(last) or last._bt_tokens.iloc[:-1].sum() < quota - size[s] + 1


def test_mixing_stops_at_the_end_of_a_block(spark, monkeypatch):
    """One-token rows, one to a block: the quota ends where a block does, and no source gets a pass too many."""
    monkeypatch.setattr(mixing, "MIN_BITS", 40)
    rows = [(i, "a" if i < 600 else "b" if i < 700 else "c", "x") for i in range(730)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).select("_bt_row.source", "_bt_tokens").toPandas()
    want, size = brute_mixing([(i, s, 1) for i, s, _ in rows])
    got = made.groupby("source")._bt_tokens.sum()
    assert {s: round(p * size[s]) for s, p in want.items()} == got.to_dict()


def test_topk_odd(spark):
    rows = [(0, [0.5, 0.5]), (50, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [1e30, -1e30]), (7, [])]
    vectors = topk_search.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("vec_id <> 6")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 5), (0, 4, 50), (0, 5, 7), (50, 1, 0), (50, 2, 1), (50, 3, 1), (50, 4, 5), (50, 5, 7)]
    assert topk_search.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_topk_of_wide_numbers(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1.0]), (2, [1.0, 0.0]), (3, [-1e30, 2.0]), (4, [1e30, 1.5]), (50, [0.25, 0.5])]
    vectors = topk_search.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["query_id"], r["vec_id"]) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 3).orderBy("query_id", "rank").collect()]
    exact = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = {q: sorted((d for d in exact if d != q), key=lambda d: (-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(exact[q], exact[d])))), d))[:3] for q in (0, 50)}
    assert got == [(q, d) for q in (0, 50) for d in want[q]]


def test_topk_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "RANGE", 300)
    monkeypatch.setattr(topk_search, "CHUNK", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = [(int(i), [float(x) for x in centres[i // 100] + 0.1 * rng.normal(size=8)]) for i in range(2000)]
    vectors = topk_search.whole(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()}
    m = np.floor(256 * np.array([v for _, v in rows]))
    for q in range(0, 2000, 50):
        s = m @ m[q]
        s[q] = -np.inf
        for rank, d in enumerate(np.lexsort((np.arange(2000), -s))[:5]):
            assert got[q, rank + 1] == (d, int(s[d]))


def test_topk_floor_prunes_blocks():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8))
    docs = np.floor(256 * (np.repeat(centres, 300, axis=0) + 0.05 * rng.normal(size=(6000, 8))))
    ids, qs = np.arange(6000), docs[::600]
    open_, floored = [], []
    q, _, s = topk_search.search(ids, docs, ids[::600], qs, 5, None, open_)
    kth = np.array([s[q == i][-1] for i in range(len(qs))], object)
    again = topk_search.search(ids, docs, ids[::600], qs, 5, kth, floored)
    assert (again[2] == s).all() and sum(floored) <= sum(open_) < 0.5 * len(qs) * (6000 / topk_search.BLOCK)


def test_topk_blocks():
    rng = np.random.default_rng(1)
    docs, qs = rng.integers(-20, 20, (3000, 8)).astype(float), rng.integers(-20, 20, (40, 8)).astype(float)
    ids = rng.permutation(3000)
    q, i, s = topk_search.search(ids, docs, ids[:40], qs, 5)
    for n in range(40):
        want = sorted((-int(x), int(d)) for x, d in zip(docs @ qs[n], ids) if d != ids[n])[:5]
        assert sorted(zip((-s[q == n]).astype(int).tolist(), i[q == n].tolist())) == want


def test_substrings(spark, docs, odd, none):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, "alpha beta " * 3 + passage + " tail of one"), (2, "some other start here: " + passage + "; another end"), (3, "nothing " + " ".join(f"own{i}" for i in range(80)))]
    made = {r["doc"]: r for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(made) == {2} and made[2]["dup_of"] == [1] and made[2]["ends"][0] - made[2]["starts"][0] > 0.8 * len(passage)
    found = {r["doc"]: r for r in substring_dedup.repeated_spans(docs).collect()}
    seen, first = {}, {}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    for d in sorted(texts):
        ends = substring_dedup.cuts(texts[d])
        for s, e in zip([0, *ends], ends):
            first.setdefault(texts[d][s:e], d)
    for d, data in texts.items():
        runs, ends = [], substring_dedup.cuts(data)
        for s, e in zip([0, *ends], ends):
            if first[data[s:e]] < d:
                runs = [*runs[:-1], (runs[-1][0], e)] if runs and runs[-1][1] == s else [*runs, (s, e)]
        seen[d] = [r for r in runs if r[1] - r[0] >= substring_dedup.MIN_RUN]
    assert {d: list(zip(r["starts"], r["ends"])) for d, r in found.items()} == {d: r for d, r in seen.items() if r}
    kept = {r["_bt_row"]["doc_id"]: r["_bt_text"] for r in substring_dedup.without_repeats(docs).collect()}
    for d, data in texts.items():
        for s, e in reversed(seen[d]):
            data = data[:s] + data[e:]
        assert kept[d] == data.decode()
    assert substring_dedup.without_repeats(odd).count() == odd.count() and substring_dedup.without_repeats(none).count() == 0


def brute_lines(rows, min_sites):
    """(doc_id, source, text) -> doc_id, text without the lines of many sites but for their first place."""
    sites, first = {}, {}
    for i, source, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if bare := line.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(bare, set()).add(source)
                first[bare] = min(first.get(bare, (i, at)), (i, at))
    common = {x for x, s in sites.items() if len(s) >= min_sites}
    return [(i, "\n".join(x for at, x in enumerate(text.split("\n")) if (b := x.strip(" \t\n\x0b\x0c\r")) not in common or first[b] == (i, at))) for i, _, text in rows]


def test_pipeline(spark, docs, none):
    made = corpus_pipeline.run(spark, SF).toPandas()
    check_packing(made)
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    rated = brute_quality([(i, t) for i, _, t in rows], trusted)
    assert all(abs(r[6] - quality_rules.THRESHOLD) > 1e-5 for r in rated.values())
    lines = brute_lines([r for r in rows if not rated[r[0]][5] and rated[r[0]][6] >= quality_rules.THRESHOLD], line_dedup.MIN_SITES)
    comp = brute_components(lines, corpus_pipeline.WIDTH, corpus_pipeline.PERCENT)
    assert set(made.doc_id) == {i for i, (_, c) in comp.items() if c == i}
    out = none
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


def test_lines_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = dict(brute_lines([(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], line_dedup.MIN_SITES))
    assert {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs).collect()} == want


def test_pipeline_odd(spark, odd):
    out = odd
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, out, SF)
        assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} == {None, 1, 3, 4, 5, 8, 9, 11, 12}
