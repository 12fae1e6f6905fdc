"""Training-data operators against brute force, exact round trips and edge cases."""

import unicodedata

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gyeol.llm import encoding, frequency, neighbours, packing, quality, queries, scan_noise, sentences, spam, splitting, visual
from gyeol.llm.textio import table

TEXTS = st.text(alphabet="가나다라 .\n,xyz。！\tあ中", max_size=400)


def plain(v):
    return "NULL" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    names = sorted(df.columns)
    rel = duck.execute(queries.ORACLE[name])
    columns = [x[0] for x in rel.description]
    assert sorted(columns) == names
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in rel.fetchall())


# --- 1 splitting ------------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(2, 60), st.data())
def test_pieces_lose_nothing(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    spans = splitting.split_spans(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e, _ in spans) == text
    assert all(e - a <= limit and b - a <= overlap for a, b, e, _ in spans)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="가나,. \n", max_size=200), st.integers(3, 30))
def test_stretches_of_pieces(text, limit):
    open_, longest = 0, 0
    for _, b, e, _ in splitting.split_spans(text, limit, 2):
        head, tail, inner = splitting.runs(text[b:e])
        longest = max(longest, open_ + head, inner, tail)
        open_ = open_ + head if tail < 0 else tail
    assert longest == max(map(len, re.split(r"[\s.!?。！？]", text)))


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "가" * 2000, "x"), (4, "가나. " * 400, "x"), (4, "가나. " * 400, "x"), (None, "짧다", "x")], "id int, text string, piece string")
    out = splitting.split_items(df, "text", ["id"])
    rows = out.collect()
    assert {r.id for r in rows} == {None, 2, 3, 4}
    assert all(len(r.piece) <= 640 for r in rows)
    assert {r.id for r in rows if r.forced} == {3}
    longest = {r.id: r.longest_run for r in splitting.longest_runs(splitting.split_items(df, "text", ["id"], only_long=True), ["id"]).collect()}
    assert longest == {3: 2000, 4: 2}
    assert splitting.split_items(df.limit(0), "text", ["id"]).count() == 0


# --- 2 statistics -----------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="가나 .\n\t|,1a-·", max_size=120), st.integers(1, 9))
def test_counts_do_not_depend_on_chunks(text, chunk):
    assert quality.text_counts(text, chunk) == quality.text_counts(text, 10_000)


def test_counts_of_long_lines_do_not_depend_on_chunks():
    lines = ["한 지은이, " + "긴 제목 " * 90 + "연구, 1999", "(1999), " + "가 " * 200 + ", 나", "낱말 " * 300 + "끝났다.", "• " + "모음 " * 200, "가\t" * 150, "감상" * 200 + "    12, 31"]
    text = "\n".join(lines)
    whole = quality.text_counts(text, 1 << 20)
    assert all(quality.text_counts(text, chunk) == whole for chunk in (7, 64, 161, 320, 1000))
    assert whole[quality.FIELDS.index("list_lines")] >= 3


def test_counts_of_a_huge_text(spark):
    text = "모음은 소리이다. 자음도 소리이다.\n" * 5000
    df = spark.createDataFrame([(1, text), (1, text), (2, text + "끝")], "id int, text string")
    rows = {r.id: r.asDict() for r in quality.text_statistics(df, "id", "text", chunk=700).collect()}
    want = dict(zip(quality.FIELDS, quality.text_counts(text, 1 << 30), strict=True))
    assert {k: rows[1][k] for k in want} == want and rows[2]["chars"] == len(text) + 1


def test_forms(spark):
    rows = [
        (1, "모음은 소리이다. 자음도 소리이다."), (2, "가나\t1.0\t2.0\n다라\t3.0\t4.0"), (3, "• 모음 자음\n• 시조 가사"), (4, "뎠짵쁣녪뉊턑엗꽩띘벨밦츎웿랡쓹쥌"), (5, None), (6, " \n "), (7, "감상    12, 31\n방언    7"), (8, "A quiet reader marks the stress."),
        (8, "A quiet reader marks the stress."), (9, "작문 | 어휘 | 단계\n통합 | 가사 | 범위"),
    ]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("form", F.lit("x"))
    got = {r.id: r.form for r in quality.text_statistics(df, "id", "text", chunk=8).collect()}
    assert got == {1: "prose", 2: "table", 3: "list", 4: "junk", 5: None, 6: None, 7: "list", 8: "prose", 9: "table"}
    assert quality.text_statistics(df.limit(0), "id", "text").count() == 0


# --- 3 frequencies ----------------------------------------------------------------------------------------------
def test_containers_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4096, 4097, 60_000):
        ids = np.sort(rng.choice(1 << 16, n, replace=False))
        raw = frequency.pack(ids)
        assert frequency.unpack(raw).tolist() == ids.tolist() and frequency.cardinality(raw) == n


def test_frequency_edges(spark):
    df = spark.createDataFrame([(1, "가나 가나 다라"), (1, "가나 가나 다라"), (70_000, "가나"), (2, None), (None, "가나"), (3, "")], "id long, text string")
    stats = {r.entry: (r.occurrences, r.records, r.first_id) for r in frequency.entry_statistics(frequency.term_containers(df, "id", "text", "f")).collect()}
    assert stats == {"가나": (3, 2, 1), "다라": (1, 1, 1), "": (3, 3, 1)}


# --- 4 scans ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("line", "want"), [
    ("말소리의 갈래  12", (True, True, False)), ("- 7 -", (False, True, False)), ("〔15〕", (False, True, False)), ("Z7", (False, True, True)), ("제2장 개념의 질문", (True, False, False)), ("p. 9", (False, True, False)),
    ("말소리의 갈%", (True, False, True)), ("모음은 소리이다.", (False, False, False)), ("", (False, False, False)),
])
def test_furniture(line, want):
    assert scan_noise.furniture(line, "말소리의 갈래") == want


def test_scan_edges(spark):
    good = "모음은 소리를 바탕으로 쓰인다. " * 3
    rows = [("passages", i, good, None, False) for i in range(40)]
    rows += [("passages", 100, "모움은 소리를 바탕으로 쓰-\n인다. 80-\n90쪽을 본다.", None, False), ("passages", 101, "독§은 쓰인다.", None, False), ("pages", 1, "책 이름\n글이다.\n12", "책 이름", True), ("passages", 102, None, None, False), ("passages", 103, "", None, False)]
    df = spark.createDataFrame(rows, "src string, item_id int, text string, title string, page boolean")
    lines, found, _ = scan_noise.noise(df, ["src", "item_id"], "text", "title", "page")
    got = {(r.src, r.item_id, r.line_no, r.noise) for r in lines.collect()}
    assert got == {("passages", 100, 1, "misread"), ("passages", 100, 1, "broken_word"), ("passages", 101, 1, "misread"), ("pages", 1, 1, "running_head"), ("pages", 1, 3, "page_number")}
    fixed = {(r.src, r.item_id): r.repaired for r in scan_noise.repaired_texts(df, ["src", "item_id"], "text", "title", "page").collect()}
    assert fixed[("passages", 100)].startswith("모음은 소리를 바탕으로 쓰인다.")
    assert fixed[("pages", 1)] == "글이다."
    assert fixed[("passages", 103)] == ""
    assert scan_noise.noise(df.limit(0), ["src", "item_id"], "text", "title", "page")[0].count() == 0


# --- 5 sentences ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("text", "want"), [
    ("국어개요…… 그 비유는 받침을 해석한다 「모음! 자음!」 하고 외치는 장면에서 갈라진다.", ["국어개요…… 그 비유는 받침을 해석한다", "「모음! 자음!」 하고 외치는 장면에서 갈라진다."]),
    ("도식은 1988. 4. 10. 이후에 정리한다. “느린 인지유행어가 바뀐다.” 보고서는 간다.", ["도식은 1988. 4. 10. 이후에 정리한다.", "“느린 인지유행어가 바뀐다.”", "보고서는 간다."]),
    ("Dr. Orrin comes at 9 a.m. sharp? See sec. 2.1. An early one.", ["Dr. Orrin comes at 9 a.m. sharp?", "See sec. 2.1.", "An early one."]),
    ("他說：「作者必須改變意思。」然後坐下了。學生往往改變背景！", ["他說：「作者必須改變意思。」然後坐下了。", "學生往往改變背景！"]),
    ("1) 그러나 반의어는 견준다. ①. 반면에 되돌아온다.", ["1) 그러나 반의어는 견준다.", "①. 반면에 되돌아온다."]),
    ("นักเรียนทบทวน\nผู้อ่านอธิบาย ครูทบทวนประโยค", ["นักเรียนทบทวน", "ผู้อ่านอธิบาย", "ครูทบทวนประโยค"]),
    ("• 모음 자음\n• 시조", []), ("가나\t1\t2", []), ("", []),
])
def test_sentences(text, want):
    last, got = 0, []
    for e in sentences.text_sentences(text):
        got.append(text[last:e].strip())
        last = e
    assert got == want


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_sentence_ends_ascend(text):
    ends = sentences.text_sentences(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) and not text[e - 1].isspace() for e in ends)


# --- 6 neighbours -----------------------------------------------------------------------------------------------
def test_misread_words_do_not_depend_on_size(spark):
    counts = [("통까여", 4), ("통하여", 600), ("교사", 30), ("교사는", 20), ("교사가", 20), ("가사", 900)]
    for times in (1, 10, 100):
        forms = spark.createDataFrame([(w, n * times) for w, n in counts], "word string, n bigint")
        assert {(r.word, r.repair) for r in scan_noise.repairs(forms).collect()} == {("통까여", "통하여")}, times


def test_misread_words_of_a_hot_text(spark):
    rows = [(i, f"{i} 통하여 가르칠 수 있다") for i in range(120)] + [(1000 + i, "통까여 가르칠 수 있다") for i in range(60)] + [(1000, "통까여 가르칠 수 있다")]
    df = spark.createDataFrame(rows, "item_id int, text string").withColumns({"title": F.lit(None).cast("string"), "page": F.lit(False)})
    lines = scan_noise.noise(df, ["item_id"], "text", "title", "page")[0].collect()
    assert sorted((r.item_id, r.line_no, r.noise) for r in lines) == [(1000 + i, 1, "misread") for i in range(60)]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 128))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.25, 0.4)] + [np.repeat(base[:1], 12, axis=0)])
    bad = [("n0", None), ("n1", [0.0] * 128), ("n2", [1.0]), ("n3", [float("nan")] * 128), ("n4", [None] * 128)]
    rows = [(f"d{i:04d}", v.tolist()) for i, v in enumerate(x)] + bad + [("d0000", x[0].tolist())]
    df = spark.createDataFrame(rows, "digest string, vector array<float>")
    got = {(r.digest, r.neighbour) for r in neighbours.neighbours(df, "digest", "vector").collect()}
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(len(y)):
        for j in sorted(range(len(y)), key=lambda j: (-round(s[i, j], 6), j))[:5]:
            if s[i, j] >= 0.9:
                want.add((f"d{i:04d}", f"d{j:04d}"))
    assert len(got & want) >= 0.95 * len(want)
    assert not any(d.startswith("n") for d, _ in got)
    assert neighbours.neighbours(df.limit(0), "digest", "vector").count() == 0


def test_far_neighbours_are_found(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((200, 128))
    x = np.concatenate([base, base[:40] + rng.standard_normal((40, 128)) * 0.3, np.repeat(base[:1], 9, axis=0)]).astype(np.float32)
    df = spark.createDataFrame([(f"d{i:04d}", v.tolist()) for i, v in enumerate(x)], "digest string, vector array<float>")
    got = {(r.digest, r.neighbour) for r in neighbours.neighbours(df, "digest", "vector", at_least=-2.0).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = np.round(y @ y.T, 9)
    np.fill_diagonal(s, -3)
    assert got == {(f"d{i:04d}", f"d{j:04d}") for i in range(len(y)) for j in sorted(range(len(y)), key=lambda j: (-s[i, j], j))[:5]}


def test_hot_bucket_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1, 128)) + rng.standard_normal((60, 128)) * 0.1
    df = spark.createDataFrame([(f"d{i:02d}", v.tolist()) for i, v in enumerate(x)], "digest string, vector array<float>")
    got = neighbours.neighbours(df, "digest", "vector")
    assert got.groupBy("digest").count().where("count = 5").count() == 60


def test_recall_holds_where_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "BUCKET", 32)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 128))
    of = np.r_[np.zeros(200, int), rng.integers(0, 12, 400)]  # one centre holds a third of all vectors
    x = (centres[of] + 0.9 * rng.standard_normal((600, 128))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    got = {}
    for r in neighbours.neighbours(df, "id", "vector", at_least=-2.0).collect():
        got.setdefault(r.digest, set()).add(r.neighbour)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -3)
    want = np.argsort(-s, axis=1)[:, :5]
    assert all(len(got[i]) == 5 for i in range(600))
    assert sum(len(got[i] & set(want[i].tolist())) for i in range(600)) >= 0.9 * 5 * 600


def test_classes(spark, small):
    rows = {(r.src, r.id): r for r in queries.p7_classes(spark, small).collect()}
    pairs = queries.p7_found(spark, small).collect()
    links = {}
    for r in pairs:
        for i in (r.id_a, r.id_b):
            links[r.src, i] = links.get((r.src, i), 0) + 1
        assert rows[r.src, r.id_a].class_id == rows[r.src, r.id_b].class_id
    assert {k: r.links for k, r in rows.items() if r.links} == links


# --- 7 look-alikes ----------------------------------------------------------------------------------------------
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="가각ᄀ́a̧é漢Ａ　 \n​рм①", max_size=30), max_size=5))
def test_canonical_is_stable_and_decomposition_blind(texts):
    form = visual.canonical(texts)
    assert visual.canonical(form) == form
    assert visual.canonical([unicodedata.normalize("NFD", t) for t in texts]) == form


def test_stable_characters_are_their_own_form():
    import re

    ok = re.compile(f"[{visual.STABLE}]")
    chars = [c for c in map(chr, range(0x20, 0xD800)) if ok.match(c)]
    assert [c for c, f in zip(chars, visual.canonical(chars), strict=True) if c != f and c != " "] == []


def test_found_pairs_equal_brute_force(spark, small):
    rows = {(r.id, r.raw) for r in table(spark, small, "passages").where("raw IS NOT NULL").collect()}
    by: dict = {}
    for i, t in rows:
        if f := visual.canonical([t])[0]:
            by.setdefault(f, []).append((i, t))
    want = {("passages", a, b) for g in by.values() for a, s in g for b, t in g if a < b and s != t}
    got = {tuple(r) for r in queries.p7_found(spark, small).where("src = 'passages'").collect()}
    assert got == want


# --- 8 encoding -------------------------------------------------------------------------------------------------
def test_encoding_equals_public_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    for r in queries.p8_ids(spark, small).collect():
        assert list(r.ids) == (t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_decode_to_the_text(text):
    e = encoding.encoder(f"{encoding.TOKENIZERS}/byte_bpe_50k.tiktoken")
    back = {v: k for k, v in e.ranks.items()}
    assert b"".join(back[i] for i in e.encode_batch([text])[0].tolist()) == text.encode("utf-8", "replace")


# --- 9 packing --------------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from([None, "a", "b"]), st.sampled_from([None, b"1", b"2"])), max_size=40))
def test_bins_hold(items):
    sizes, sources, clusters = ([x[i] for x in items] for i in range(3))
    bins = packing.best_fit(sizes, sources, clusters, 50)
    for b in set(bins):
        here = [i for i, x in enumerate(bins) if x == b and sizes[i]]
        assert sum(sizes[i] for i in here) <= 50
        copies = [clusters[i] for i in here if clusters[i]]
        assert len(copies) == len(set(copies))


def test_pack_whole(spark, small):
    out = queries.p9_containers(spark, small).collect()
    docs = table(spark, small, "documents")
    sizes = {r.doc_id: r.n_tokens for r in encoding.encode(docs, "text", ["doc_id"], sizes_only=True).collect()}
    got: dict = {}
    used: dict = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert got == sizes and max(used.values()) <= packing.CAPACITY
    assert sum(used.values()) / (len(used) * packing.CAPACITY) > 0.9
    assert packing.pack(docs.limit(0), "doc_id", "text", "source").count() == 0


# --- 10 stuffed pages -------------------------------------------------------------------------------------------
def test_stuffed(spark):
    prose = "모음은 공기의 흐름이 막히지 않고 나는 소리이다. 자음은 흐름이 막혀 나는 소리이다. 운율은 소리의 되풀이에서 생긴다. "
    rows = [(i, prose * (1 + i % 3)) for i in range(30)]
    rows += [(100, "★교재 할인★ 교재\n교재 할인 추천 할인 교재 할인\n" * 8), (101, "교재 http://a1.example/1\n할인 http://b2.test/22\n자료 http://c3.example/3\n"), (102, "#교재 #할인 #추천 #교재 #자료 #할인 #무료 #추천"), (103, prose + "#교재 #할인"), (104, None), (105, ""), (106, "교재")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r.doc_id for r in spam.stuffed(df, "doc_id", "text").collect()} == {100, 101, 102}
    assert spam.coherence(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p4_repaired", "p5_found", "p6_neighbours", "p6_embeddings", "p9_fill", "p10_coherence"])
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize(("stored", "form"), [("𝐀𝟏", "A1"), ("ᎪᎡ", "AR"), ("օո", "on"), ("Ｆｕｌｌ", "Full"), ("Ⅲ장", "Ⅲ장"), ("ЅІХ", "SIX")])
def test_look_alikes(stored, form):
    assert visual.canonical([stored]) == [visual.canonical([form])[0]]
