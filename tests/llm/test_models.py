"""Language model, language ID, token files, line rules, URL filter, decontamination, packing, pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from rolescope.llm import class_lm, decontaminate, language_id, line_rules, packing, queries, token_files, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("dictionary", [1 << 20, 300])
def test_class_lm_base_is_exact_and_beaten(spark, dictionary):
    docs = documents(spark).select("doc_id", "text")
    model, tail = class_lm.train(docs.where(~class_lm.held_out("doc_id")), dictionary=dictionary, exchange=256, classes=16)
    got = {r.doc_id: r for r in class_lm.score(docs, model, tail).collect()}
    rows = docs.collect()
    toks = {r.doc_id: WORD.findall(r.text.translate({c: c + 32 for c in range(65, 91)})) + [None] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in toks}
    count = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for d, ws in toks.items():
        r = got[d]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(ws), sum(count[w] > 0 for w in ws))
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens))
    own = [got[d] for d in toks if held[d]]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_class_lm_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b a b c", "b a b a", "x y x y z", "a b x y", "a a b"])], "doc_id long, text string")
    model, tail = class_lm.train(docs, exchange=4, classes=2)
    step, emit = model.logs()
    assert np.allclose((10 ** step).sum(axis=1), 1)
    own = model.vocabulary
    by_class = np.bincount(model.class_of[own.unit_of_rank], weights=10 ** emit)
    assert np.allclose(by_class[by_class > 0], 1)
    unseen = (own.tail_total + own.tail_distinct + 1)
    assert math.isclose(sum(r.n + 1 for r in tail.collect()) + 1, unseen)


def test_class_lm_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (3, "a B", 3.0), (3, "a B", 3.0)], "doc_id long, text string, score double")
    model, tail = class_lm.train(docs.limit(0))
    out = class_lm.score(docs, model, tail).collect()
    assert [r.n_tokens for r in sorted(out, key=lambda r: r.n_tokens)] == [1, 1, 3, 3]
    assert all(r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in out)
    model, tail = class_lm.train(docs)
    assert {(r.n_tokens, r.n_known) for r in class_lm.score(docs, model, tail).collect()} == {(1, 1), (3, 3)}
    assert class_lm.score(docs.limit(0), model, tail).count() == 0


def test_exchange_gain_is_the_change_of_the_likelihood():
    rnd = np.random.default_rng(1)
    n = rnd.integers(0, 9, (7, 7)).astype(float)
    class_of = np.array([0, 1, 2, 0, 1, 2, 0])

    def matrix(c):
        out = np.zeros((3, 3))
        np.add.at(out, (c[:, None].repeat(7, 1), c[None, :].repeat(7, 0)), n)
        return out

    w = 4
    behind = np.bincount(class_of, weights=n[w], minlength=3)
    before = np.bincount(class_of, weights=n[:, w], minlength=3)
    best, gain = class_lm.best_class(matrix(class_of), int(class_of[w]), behind, before, n[w, w], 3)
    tried = []
    for c in range(3):
        moved = class_of.copy()
        moved[w] = c
        tried.append(class_lm.likelihood(matrix(moved)))
    assert best == int(np.argmax(tried)) and math.isclose(gain, max(tried) - tried[class_of[w]], abs_tol=1e-6)


def test_class_lm_clusters_words_beyond_the_frequent_ones(spark, monkeypatch):
    rnd = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(1200)] for k in "abc"]  # a is followed by b, b by c, c by a
    texts = [" ".join(rnd.choice(kinds[(p + d) % 3]) for p in range(300)) for d in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model, tail = class_lm.train(docs, classes=3)
    own = model.vocabulary
    assert own.exchange == len(own.counts) > 3000
    rank = own.table.find(class_lm._hashes([" ".join(w for kind in kinds for w in kind)])[0][:-1]).reshape(3, -1)
    of_kind = [np.bincount(model.class_of[own.unit_of_rank[r[r >= 0]]], minlength=3) for r in rank]
    assert sorted(int(c.argmax()) for c in of_kind) == [0, 1, 2] and all(c.max() >= 0.95 * c.sum() for c in of_kind)
    monkeypatch.setattr(class_lm, "PARTS", 1 << 20)  # each word's neighbours in several parts
    again, _ = class_lm.train(docs, classes=3)
    assert np.array_equal(again.class_of, model.class_of) and np.array_equal(again.matrix, model.matrix)
    assert again.matrix.sum() == own.total


def test_class_lm_turn_reads_one_half_and_counts_its_moves_only(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.6)) % 90}" for _ in range(60)) for _ in range(80)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    whole, _ = class_lm.train(docs, classes=5)
    monkeypatch.setattr(class_lm, "PAIRS_AT_ONCE", 64)  # many shards
    monkeypatch.setattr(class_lm, "TOKENS_AT_ONCE", 7)
    sharded, _ = class_lm.train(docs, classes=5)
    assert np.array_equal(sharded.class_of, whole.class_of) and np.array_equal(sharded.matrix, whole.matrix)

    own, n_classes = whole.vocabulary, len(whole.matrix)
    chunks = class_lm.neighbours(docs, own)

    def added_up(of, *halves):
        found = of(iter(chunks.select(*class_lm._columns(*halves)).toArrow().to_batches()))
        return sum(np.frombuffer(b.column("matrix")[0].as_py()) for b in found).reshape(n_classes, n_classes)

    class Sent:
        def __init__(self, *value):
            self.value = value

    def counted(class_of):
        out = np.zeros((n_classes, n_classes))
        for text in texts:
            units = class_of[own.units_of(class_lm._hashes([text])[0])[0]]
            np.add.at(out, (np.append(class_of[own.end_unit], units[:-1]), units), 1)
        return out

    class_of = np.append(np.arange(own.exchange) % 5, np.arange(5, n_classes))
    assert own.exchange > 20 and chunks.count() > 5 and np.array_equal(added_up(class_lm._matrices(Sent(class_of, n_classes)), 0, 1, 2), counted(class_of))
    for half in class_lm.HALVES:
        tried, moved = class_of.copy(), np.arange(half, own.exchange, 2)[:-3]
        tried[moved] = (tried[moved] + 1 + moved % 4) % 5
        change = added_up(class_lm._changes(Sent(class_of, tried, n_classes), half), half)
        assert change.any() and np.array_equal(change, counted(tried) - counted(class_of))


def test_exchange_takes_the_logarithms_of_equal_counts_once(monkeypatch):
    rnd = np.random.default_rng(2)
    words, classes = 400, 20
    matrix = rnd.integers(50, 900, (classes, classes)).astype(float)
    own, itself = rnd.integers(0, classes, words), np.zeros(words)
    behind, before = (rnd.integers(0, 3, (words, classes)).astype(float) for _ in range(2))
    single = [class_lm.best_class(matrix, int(own[i]), behind[i], before[i], 0.0, classes) for i in range(words)]
    taken, of = [], class_lm._xlogx
    monkeypatch.setattr(class_lm, "_xlogx", lambda x: taken.append(x.size) or of(x))
    best, gain = class_lm.best_classes(matrix, own, behind, before, itself, classes)
    assert [(int(b), float(g)) for b, g in zip(best, gain)] == single
    assert sum(taken) < 15 * words * classes  # a row of logarithms per neighbouring class took 35 times words x classes


def test_language_id_held_out_accuracy_and_edges(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.fold("doc_id", 3) != 1))
    held = language_id.predict(docs.where(language_id.fold("doc_id", 3) == 1), model).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "12 !? ---", "x"), (3, "a", "x"), (3, "日本", None), (4, "ß" * 5, "x")],
                                "doc_id long, text string, lang_pred string")
    got = [(r.text, r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()]
    assert [g[1] for g in got[:3]] == ["und"] * 3 and all(g[1] in model.languages for g in got[3:])
    assert language_id.predict(docs.limit(0), model).count() == 0
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_language_id_long_text_in_pieces_counts_as_whole(spark, monkeypatch):
    docs = documents(spark).select("doc_id", "text", "lang")
    model = language_id.train(docs)
    text = " ".join(r.text for r in docs.where("lang = 'de'").limit(20).collect())
    whole = language_id.predict_texts(model, [text, "ab"])
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 777)
    assert language_id.predict_texts(model, [text, "ab"]) == whole


def test_spark_hash_of_arrays(spark):
    x = np.array([0, 1, -5, 1 << 62], np.int64)
    rows = spark.createDataFrame([(int(v),) for v in x], "gram long").selectExpr(*[f"xxhash64(gram, {i})" for i in range(3)]).collect()
    assert [[r[i] for r in rows] for i in range(3)] == [language_id.spark_xxhash(x, i).tolist() for i in range(3)]


def test_token_files_round_trip(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(None, "a  b"), (7, None), (7, "x" * 3000), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file:{tmp_path}/tokens"
    manifest = token_files.write_tokens(docs, BPE, folder, docs_per_file=50)
    got = token_files.read_tokens(manifest, folder).collect()
    tok, want = Tokenizer.from_file(BPE), Counter()
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    ids = [math.inf if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids) and manifest.count() > 1
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), BPE, f"{folder}-none"), f"{folder}-none").count() == 0


def test_encoder_is_the_library_on_odd_white_space():
    own = token_files.Encoder(BPE)
    rnd = random.Random(1)
    letters = list("ab éß'’.,!?1 \n\t  日_-<|> 　\x1c")
    texts = ["don't we'll 'tis 's", "a <|endoftext|> b", "foo's. bar'.. ñandú... Ünter!", "a \n", "\n\nx", "ª º ǅ"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), own.width).tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_line_rules():
    prose = " ".join(f"word{i}" for i in range(30)) + "."
    said = line_rules.judge("\n".join([prose, prose, "", "Home | About | News | Shop | Help", "All rights reserved.", "no end"] + [prose + " more."]))
    assert (said.n_dup_lines, said.base_failed) == (1, True) and said.n_repeat_words == 90
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) + "." for i in range(5))
    menu = "\n".join("a | b | c | d" for _ in range(3))
    said = line_rules.judge(f"{text}\n{menu}")
    assert said.kept and said.cleaned == text and said.n_symbols == 9 and said.n_words == 121
    assert not line_rules.judge(text.replace(".", "").replace("\n", " \n")).kept
    assert line_rules.judge(None) == line_rules.Judged(0, 0, 0, 0, 0, True, 0, False, "")


def test_line_rules_columns(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "é #\ta", 2), (1, "é #\ta", 2)], "doc_id long, text string, kept int")
    out = line_rules.clean_lines(docs).collect()
    assert [(r.n_words, r.word_chars, r.n_symbols) for r in out] == [(0, 0, 0), (3, 3, 1), (3, 3, 1)]
    assert line_rules.clean_lines(docs.limit(0)).count() == 0


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.net", "https://a.example.net/en/1", "https://example.net/en", "http://xexample.net/en/", "http://net/",
            "http://b.org/fr/", "http://org/fr/x?y", "http://example.com/de/9#z", "http://www.example.com/de", "http://a/b://c/d", "x\ny://h/p\nq",
            "https://casino-win.example.com/en/1", "https://tiontion.example.com/en/1", "http://İ.example.org/q"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    for i, u in enumerate(urls):
        host, path = by_hand(u)
        fits = [(len(t), t, v) for v, t in url_filter.RULES for h, p in [t.split("/", 1)]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None), u
        assert r.verdict == (max(fits)[2] if fits else "block" if r.score >= 0.5 else "allow")
    assert got[14].verdict == "block" and got[15].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_filter_on_hosts_it_has_not_seen(spark):
    """No host of the given pages is in the labelled table."""
    seen = {by_hand(r.url)[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.").split(".")[0]
            for r in url_filter.labelled_urls(spark).collect()}
    unwanted = ("casino-win", "free-bets", "cheap-pills", "spam-farm", "ads-track", "adult-x")
    rows = url_filter.judge_urls(spark.read.parquet(f"{SF}/pages.parquet").select("url")).collect()
    name = lambda r: r.host.removeprefix("www.").removeprefix("blog.").removeprefix("m.").split(".")[0]
    assert not seen & {name(r) for r in rows} and not seen & set(unwanted)
    right = [(r.score >= 0.5) == (name(r) in unwanted) for r in rows]
    assert sum(right) >= 0.98 * len(right)


def test_alignment_like_full_table():
    rnd = random.Random(8)
    for _ in range(60):
        x, y = ([rnd.randrange(4) for _ in range(rnd.randrange(1, 15))] for _ in range(2))
        h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            for j, q in enumerate(y, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if p == q else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.align(np.array(x), np.array(y))[0] == max(map(max, h))


def test_decontamination_finds_edited_copies(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [say(40) for _ in range(6)]
    docs, planted = [], set()
    for d in range(80):
        own = say(150)
        if d % 4 == 0:
            copy = list(items[d % 6])
            for _ in range(d % 3 * 3):
                copy[rnd.randrange(40)] = "changed"
            if d % 8 == 0:
                del copy[20]
            own[60:60] = [w.title() + "," for w in copy]
            planted.add((d, d % 6))
        docs.append((d, " ".join(own)))
    docs += [(None, None), (90, ""), (0, docs[0][1])]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(None, None), (9, "two words")], "item_id long, text string")
    got = decontaminate.contaminated(left, right).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted and sum(r.doc_id == 0 for r in got) == 2
    assert all(abs(r.first_word - 60) <= 6 and abs(r.end_word - 100) <= 6 for r in got)
    clean = decontaminate.keep_clean(left, right)
    assert clean.count() == len(docs) - len(planted) - 1
    assert decontaminate.contaminated(left, right.limit(0)).count() == 0 == decontaminate.contaminated(left.limit(0), right).count()


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.start)
        assert own[0].start == 0 and all(x.start + x.length == y.start for x, y in zip(own, own[1:]))
        assert own[-1].start + own[-1].length <= capacity
        assert len({r.source for r in own}) == len(own) == len({r.cluster for r in own})
    return bins


def test_packing_keeps_all_and_no_conflicts(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 90) + [str(i % 50)]), "hot" if i % 3 else f"s{i % 40}") for i in range(600)]
    rows += [(None, None, None), (1, "a", None), (1, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(docs, capacity=64, pieces_per_task=200).collect()
    check_bins(out, 64)
    sizes = Counter()
    for r in out:
        sizes[r.doc_id] += r.length
    want = Counter()
    for d, t, _ in rows:
        want[d] += len((t or "").split()) + 1
    assert sizes == want
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_takes_the_tightest_compatible_bin():
    rnd = random.Random(9)
    rows = [(rnd.randrange(1, 40), rnd.choice("aaabcdefg"), rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, rnd.random()])) for _ in range(300)]
    placed = {i: (b, s) for i, _, b, s, _ in packing.pack_part(rows, 40)}
    bins: list = []
    for i in sorted(range(300), key=lambda i: (-(rows[i][0] % 40), i)):
        size, source, cluster = rows[i]
        fit = [b for b in bins if b["left"] >= size and source not in b["s"] and cluster not in b["c"]]
        own = next(b for b in [*bins, None] if b is None or b["id"] == placed[i][0])
        if fit:
            assert own is not None and own["left"] == min(b["left"] for b in fit) and own in fit
        else:
            assert own is None
            own = {"id": placed[i][0], "left": 40, "s": set(), "c": set()}
            bins.append(own)
        own["left"] -= size
        own["s"].add(source)
        own["c"].add(cluster)


def test_pipeline_stages(spark):
    docs = documents(spark)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = queries.common.written(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
        for r in docs.collect():
            old = before[r.doc_id]
            assert name == "suffix_dedup" and len(r.text) == r.n_chars <= old.n_chars or r == old
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_bins(packed, packing.CAPACITY)
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
