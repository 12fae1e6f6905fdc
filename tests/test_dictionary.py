"""Dictionary, concepts and evidence on small rows with known results."""

from pyspark.sql import functions as F

from gyeol.functions.text import split_sentences
from gyeol.operators import concepts, dictionary, evidence, search
from gyeol.plans import question


def test_definitions_with_context(spark):
    text = "절이 관형사화되어 관형어로서 쓰이면 이를 관형사절이라고 부른다. 이러한 관형사절은 두 가지로 나뉜다. 빨간 장미꽃이 아름답다 하는 말은 진술에 불과하다."
    p = spark.createDataFrame([(1, 1, "body", text), (1, 2, "note", "관형사절은 관형어로 쓰이는 절이다."), (2, 3, "body", "동격 관형사절이란 성분을 완전하게 갖춘 관형사절이다."), (2, 4, "body", None), (3, 5, None, "")], "page_id int, id int, kind string, display string")
    s = dictionary.page_sentences(p)
    assert s.count() == 5
    keys = spark.createDataFrame([("관형사절",), ("동격관형사절",), ("없는말",)], "key string")
    scored = dictionary.scored_definitions(s, keys)
    best = {(r.page_id, r.key): r for r in dictionary.with_context(s, dictionary.page_definitions(scored)).collect()}
    assert set(best) == {(1, "관형사절"), (2, "동격관형사절")}
    assert best[1, "관형사절"].score == 10 and best[1, "관형사절"].more == "이러한 관형사절은 두 가지로 나뉜다."
    assert {r.key: r.longer for r in dictionary.longer_terms(keys).collect()} == {"관형사절": ["동격관형사절"]}
    assert dictionary.page_sentences(p.limit(0)).count() == 0


def test_away_definitions(spark):
    scored = spark.createDataFrame([(1, 1, 0, "관형절", 10), (2, 2, 0, "관형절", 9), (3, 3, 0, "운율론", 9), (4, 4, 0, "절", 10)], "page_id int, id int, at int, key string, score int")
    pages = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "b", 30), (4, "b", 40)], "id int, book_id string, pdf_page int")
    indexed = spark.createDataFrame([("a", "관형절", 50, 7), ("b", "관형절", 90, None), ("b", "운율론", 31, None)], "book_id string, key string, pdf_page int, score int")
    assert [(r.book_id, r.key) for r in dictionary.away_definitions(scored, pages, indexed).collect()] == [("b", "관형절")]


def test_misread_terms(spark):
    counts = spark.createDataFrame([("연걸어미", 2), ("연결어미", 300), ("형태로", 5), ("형태소", 300), ("통작성", 2), ("동작성", 1)], "word string, n int")
    keys = spark.createDataFrame([("연결어미", False), ("형태소", False), ("동작성", True)], "key string, curated boolean")
    got = {(r.word, r.key) for r in dictionary.misread_terms(counts, keys).collect()}
    assert got == {("연걸어미", "연결어미"), ("통작성", "동작성")}


def test_topics(spark):
    rows = [("제1장 음운의 변동", "국어"), ("1. 모음 체계", "국어"), ("국어의 소리", "국어의 소리"), ("문장이 끝났다.", ""), ("음운과", ""), ("차례 ___ 12", ""), ("123", ""), ("요약", ""), (None, "")]
    df = spark.createDataFrame(rows, "l string, t string").select("l", dictionary.topic_of(F.col("l"), F.col("t")).alias("topic"))
    assert {r.l: r.topic for r in df.collect() if r.topic} == {"제1장 음운의 변동": "음운의 변동", "1. 모음 체계": "모음 체계"}


def test_catalogue(spark):
    sources = spark.createDataFrame([("관형절", "관형절", "a", "문법", "q"), ("관형절", "관형 절", "b", "문학", None), ("저13장", "저13장", "h", "문학", None), ("찾아보기", "찾아보기", "a", "문법", None)], "key string, label string, book string, category string, quote string")
    items = dictionary.catalogue(
        sources, spark.createDataFrame([("관형절", "문법", 1), ("통시적 변화", "문법", 0)], "label string, area string, books long"), spark.createDataFrame([("관형절",)], "key string"),
        spark.createDataFrame([("h",)], "book string"), spark.createDataFrame([("찾아보기",)], "key string"),
    )
    assert [(r.name, r.areas, r.books, r.flags) for r in items.orderBy("order").collect()] == [("관형 절", 6, 2, 7), ("통시적 변화", 2, 0, 2)]


def test_cards(spark):
    grams = spark.createDataFrame([("q", g) for g in question.ngrams("관형절과 절의 차이")], "question string, gram string")
    aliases = spark.createDataFrame([(0, "관형절"), (0, "관형사절")], "grp int, name string")
    sources = spark.createDataFrame([("관형사절", "a", 5, "인용", 9, True, False), ("관형사절", "a", 5, "다른 인용", 7, True, False), ("관형사절", "b", 2, None, 0, True, False), ("절", "a", 1, None, 0, True, False)], "key string, book string, pdf_page int, quote string, score int, indexed boolean, damaged boolean")
    found = dictionary.found_terms(grams, sources.select("key", F.col("key").alias("shown")).distinct(), aliases)
    got = dictionary.cards(found, sources).orderBy("place", "nth").collect()
    assert [(r.gram, r.book, r.quote) for r in got] == [("관형절", "a", "인용"), ("관형절", "b", None)]


def test_concept_items_and_pages(spark):
    entry = '{"id":"c1","label":"모음","summary":"요약","sections":[{"heading":"뜻","items":["하나",{"label":"둘","text":"설명","examples":["보기","예"],"refs":[1,7],"sub":[{"label":"셋","text":"더","refs":[0]},{"text":"끝"}]}]}],"sources":[{"id":10},{"id":20}]}'
    rows = spark.createDataFrame([(entry,), ('{"id":"c2","sections":[]}',), ("kaputt",), (None,)], "j string")
    items = concepts.concept_items(rows, "j")
    assert [(r.label, r.text, r.pages) for r in items.orderBy("item").collect()] == [("", "하나", []), ("둘", "설명 셋: 더 끝 예: 보기 / 예", [20, 10])]
    assert concepts.entry_prose(rows, "j").first().prose == "뜻 하나 둘 설명 셋: 더 끝 예: 보기 / 예"
    matched = spark.createDataFrame([("c1", 0, "exact")], "id string, rank int, match string")
    asked = question.asked("모음", question.groups("모음"))
    assert [r.page for r in concepts.concept_pages(items, matched, asked).orderBy("place").collect()] == [20, 10]


def test_concept_match(spark):
    names = [("c1", "재귀대명사", "재귀 대명사는 앞의 말을 다시 가리킨다."), ("c2", "대명사", "대명사는 이름을 대신한다."), ("c3", "안긴문장", "안긴문장은 다른 문장 안에 든다."), ("c4", "운율", "운율은 소리의 되풀이이다.")]
    asked = [("q1", "재귀 대명사는 무엇인가요?"), ("q2", "안긴문장과 이어진문장의 차이"), ("q3", "시의 운율")]
    grams = spark.createDataFrame([(q, g) for q, t in asked for g in question.ngrams(t)], "question string, gram string")
    got = concepts.matched(grams, spark.createDataFrame(names, "concept string, name string, body string")).collect()
    assert {(r.question, r.concept, r.match, r.term) for r in got} == {("q1", "c1", "exact", "재귀대명사"), ("q1", "c2", "related", "대명사"), ("q2", "c3", "exact", "안긴문장"), ("q3", "c4", "exact", "운율")}


def test_example_pages_and_notes(spark):
    pages = spark.createDataFrame([(1, "국물[궁물]은비음화이다"), (2, "국물을먹고궁물이라한다"), (3, "국물도[궁물도]"), (4, None)], "id int, compact string")
    examples = spark.createDataFrame([("국물", "궁물"), ("같은", "같은")], "spelling string, said string")
    assert {r.id for r in concepts.example_pages(pages, examples).collect()} == {1, 3}
    notes = spark.createDataFrame([("a", "뜻", ["국물 은"], ["없는 예"]), ("b", "뜻", ["없다"], None), ("c", "", ["국물"], None), ("d", "뜻", None, None)], "key string, definition string, quotes array<string>, examples array<string>")
    texts = spark.createDataFrame([("a", "국물은 맛있다"), ("b", "국물"), ("c", "국물")], "key string, text string")
    assert {r.key: (r.status, r.quotes) for r in concepts.checked_notes(notes, texts, "key").collect()} == {"a": ("ok", ["국물 은"]), "b": ("unsupported", []), "c": ("insufficient", ["국물"]), "d": ("failed", [])}
    c = spark.createDataFrame([("t", "a", 9, True, "가"), ("t", "a", 10, False, "나"), ("t", "b", 7, True, "다")], "term string, book string, score int, opens boolean, text string")
    assert [r.text for r in concepts.preferred_paragraphs(c, "term").orderBy("place").collect()] == ["나", "다", "가"]
    a, b = (spark.createDataFrame(x, "k string, o int") for x in ([("x", 1), ("y", 2)], [("y", 0), ("z", 1)]))
    assert sorted((r.k, r.o) for r in concepts.ordered_union([a, b], "k", "o").collect()) == [("x", 1), ("y", 2), ("z", 1)]


def test_packets(spark):
    s = "모음은 공기의 흐름이 막히지 않고 나는 소리이다."
    p = spark.createDataFrame([(1, 1, 0, "body", f"{s} 짧다."), (1, 2, 1, "margin", s), (1, 3, 2, None, "12"), (2, 4, 0, "note", s)], "page_id int, id int, ordinal int, kind string, display string")
    rows = concepts.paragraphs(p, split_sentences(F.col("display")))
    labels = spark.createDataFrame([(1, "책", "3쪽"), (2, "책", None)], "page_id int, book string, page string")
    got = {r.page_id: r for r in concepts.packet(rows, labels).collect()}
    assert got[1].registry == {"S1P1": [s]} and '"page":"3쪽"' in got[1].packet and got[2].registry == {"S2P1": [s]}


def test_answers_are_checked(spark):
    answer = '{"id":"a1","sections":[{"title":"소리","points":[{"text":"모음의 뜻","citations":[{"source":"S1","quote":"모음은 공기의 흐름이 막히지 않고 나는 소리이다."}]},{"text":"없는 말","citations":[{"source":"S2","quote":"운율은 글자의 모양에서 생긴다고 널리 알려져 있다."}]},{"text":"출처 없음","citations":[]},{"text":"모르는 출처","citations":[{"source":"S1","quote":""},{"source":"S9","quote":""}]},{"text":"빈 인용","citations":[{"source":"S2","quote":""}]}]}]}'
    sources = spark.createDataFrame([("S1", "모음은 공기의 흐름이 막히지 않고 나는 소리이다. 자음은 다르다."), ("S2", "운율은 소리의 되풀이에서 생긴다.")], "source string, text string")
    claims = evidence.claims_of(spark.createDataFrame([(answer,)], "j string").select(F.from_json("j", evidence.ANSWER).alias("a")).select("a.*"))
    checked = evidence.validated(claims, sources)
    assert {r.text: r.valid for r in checked.collect()} == {"모음의 뜻": True, "없는 말": False, "출처 없음": False, "모르는 출처": False, "빈 인용": True}
    assert [(r.kept, r.dropped) for r in concepts.pruned(checked).collect()] == [(2, 3)]
    books = spark.createDataFrame([("국어교육론", 1), ("국어교육론", 2)], "stem string, volume int")
    texts = spark.createDataFrame([("t1", "국어교육론 2에서"), ("t2", "국어교육론3에 따르면"), ("t3", None)], "key string, text string")
    assert [(r.key, r.volume) for r in evidence.volumes_missing(texts, books, "key", "text").collect()] == [("t2", 3)]


def test_bullets_and_sentences(spark):
    text = "· 하나이다. " * 10
    rows = spark.createDataFrame([(1, "body", text), (2, "body", "· 하나 " * 10), (3, None, "짧다."), (4, "index", "가"), (5, "table", "표"), (6, "body", None)], "id int, kind string, raw string")
    kept = lambda asked: {r.id for r in rows.where(F.coalesce(search.kind_admissible(F.col("kind"), F.col("raw"), asked), F.lit(False))).collect()}
    assert kept(None) == {1, 3} and kept(question.asked("표를 보여줘", [("표",)])) == {1, 3, 5}
    assert search.scoped(rows.withColumn("page_id", F.col("id")), spark.createDataFrame([(1, "b", 1, 1, "q")], "id int, book_id string, pdf_page int, printed_page int, quality string"), spark.createDataFrame([("b", "t", "문법")], "id string, title string, category string"), "없는 갈래").count() == 0


def test_builds(spark):
    from gyeol.operators import build

    rows = spark.createDataFrame([(1, "가"), (2, "나"), (3, None)], "id int, text string")
    ledger = rows.where("id = 1").select("id", F.sha2("text", 256).alias("digest"))
    assert {r.id for r in build.changed(rows, ledger, "id", "text").collect()} == {2, 3}
    lengths = build.with_engine(rows, "text", "size", "int", lambda: lambda texts: [len(t) for t in texts])
    assert {r.id: r.size for r in lengths.collect()} == {1: 1, 2: 1, 3: None}
    vectors = build.with_engine(rows, "text", "vec", "array<double>", lambda: lambda texts: [[float(ord(t[0])), 1.0] for t in texts])
    assert {r.id: r.vec for r in vectors.collect()}[3] is None


def test_evidence_of_a_plan(spark):
    pages = spark.createDataFrame([(i, "a" if i < 10 else "b", i, 100) for i in range(1, 20)], "id int, book_id string, pdf_page int, chars int")
    one = spark.createDataFrame([(51, 5, "a", 1), (52, 8, "a", 2)], "id int, page_id int, book_id string, rank int")
    two = spark.createDataFrame([(61, 15, "b", 1), (51, 5, "a", 2)], "id int, page_id int, book_id string, rank int")
    got = [r.page_id for r in evidence.collected([one, two], pages, budget=(32, 1000)).orderBy("place").collect()]
    assert got == [5, 15, 8, 6, 9, 16, 4, 7, 14]
    assert len(evidence.collected([one, two], pages, budget=(4, 1000)).collect()) == 4
