import pytest
from pyspark.sql import functions as F

from gyeol.functions import hangul, text
from gyeol.operators import evaluate, layout, pages, terms
from gyeol.plans import question

SOUNDS = """국물 궁물 비음화|밥물 밤물 비음화|닫는 단는 비음화|침략 침냑 비음화|부엌문 부엉문 비음화,음절의 끝소리 규칙|읽는 잉는 비음화,자음군 단순화|신라 실라 유음화|칼날 칼랄 유음화|같이 가치 구개음화|굳히다 구치다 구개음화,거센소리되기|솜이불 솜니불 ㄴ 첨가|물약 물략 ㄴ 첨가,유음화|꽃잎 꼰닙 ㄴ 첨가,비음화,음절의 끝소리 규칙|국밥 국빱 된소리되기|좋고 조코 거센소리되기|축하 추카 거센소리되기|놓아 노아 ㅎ 탈락|닭 닥 자음군 단순화|앉다 안따 된소리되기,자음군 단순화|부엌 부억 음절의 끝소리 규칙|피어 피여 반모음 첨가"""


@pytest.mark.parametrize("row", SOUNDS.split("|"))
def test_sound_changes(row):
    spelling, said, names = row.split(" ", 2)
    assert hangul.sound_changes_of(spelling, said) == names.split(",")


@pytest.mark.parametrize("pair", [("국어", "구거"), ("다음", "보기"), ("보아", "봐"), ("국물", "국물"), (None, "가"), ("", "")])
def test_no_sound_change(pair):
    assert hangul.sound_changes_of(*pair) == []


def test_content_words():
    assert question.content_words("소설의 시점에는 어떤 것들이 있나요?") == ["소설", "시점"]
    assert question.content_words("음운 변동 중 교체에 해당하는 것을 알려줘") == ["음운", "변동", "교체"]
    assert question.content_words("작문의 과정에 대해 알려줘") == ["작문", "과정"]
    assert question.content_words("소설가 메타인지 미닫이 어린이 지도 태도") == ["소설가", "메타인지", "미닫이", "어린이", "지도", "태도"]
    assert question.content_words("") == []


def test_groups_and_relaxation():
    assert question.groups("작문의 과정에 대해 알려줘")[0] == ("작문", "쓰기", "글쓰기")
    assert question.groups("내용 생성 방법")[0] == ("내용생성", "내용창안")
    tries = question.relaxed("'두 사람이 손을 잡고 걷는다.'는 이어진문장인가?", {"이어진문장"})
    assert all(question.content_words(q) for q in tries)


DEFINITIONS = [
    ("관형사절이란 문장에서 관형어 역할을 하는 절이다.", 10), ("이러한 절을 관형사절이라고 한다.", 10), ("관형사절은 관형어 구실을 하는 절을 말한다.", 9), ("관형사절은 절의 하나이다.", 7), ("관형사절은 여러 가지로 나뉜다.", 5),
    ("여기에는 관형사절도 있다.", 1), ("명사절은 다르다.", 0), (None, 0), ("", 0),
]


@pytest.mark.parametrize(("sentence", "score"), DEFINITIONS)
def test_definition_score(sentence, score):
    assert terms.definition_score_of(sentence, "관형사절") == score


def test_term_inside_longer_term():
    assert terms.definition_score_of("동격 관형사절이란 절의 하나이다.", "관형사절", ["동격관형사절"]) == 2


def test_text_columns(spark):
    rows = [(None,), ("",), ("가 나　다 A",), ("- 12 쪽 하나\n가나 31",), ("�" * 5 + "가" * 40,), ("다음 물음에 답하시오.",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(text.compact(F.col("t")), text.text_quality(F.col("t")), text.passage_kind(F.col("t")), text.footer_number(F.col("t"))).collect()
    assert got[0] == (None, None, None, None)
    assert got[1][:3] == ("", "sparse", "fragment")
    assert got[2][0] == "가나다a"
    assert got[3][3] == 31
    assert got[4][1] == "review"
    assert got[5][2] == "exercise"


def test_index_lines(spark):
    df = spark.createDataFrame([("명사구    Z73, 321\n명사형 어미     17l, 176\n그냥 글",), (None,), ("",)], "t string")
    assert sorted(map(tuple, terms.index_entries(df, "t").select("term", "page").collect())) == [("명사구", 273), ("명사구", 321), ("명사형 어미", 171), ("명사형 어미", 176)]


def test_sort_key(spark):
    df = spark.createDataFrame([(x,) for x in ("나무", "가지", "ㄴ 첨가", "Zebra", "3", "「가」")], "label string")
    assert [r.label for r in df.orderBy(hangul.sort_key(F.col("label"))).collect()] == ["「가」", "가지", "ㄴ 첨가", "나무", "Zebra", "3"]


def test_gap_fill_and_neighbours(spark):
    df = spark.createDataFrame([("b", p, n, n) for p, n in ((1, 5), (2, None), (3, 7), (4, None), (5, 20), (6, 21), (7, 22))], "book_id string, pdf_page int, printed_page int, candidate int")
    filled = {r.pdf_page: (r.number, r.status) for r in pages.gap_fill(df).collect()}
    assert filled[2] == (6, "offset") and filled[4] == (None, None) and filled[5] == (20, "confirmed")
    assert [r.pdf_page for r in pages.neighbour_confirmed(df).collect()] == [6]
    empty = df.limit(0)
    assert pages.gap_fill(empty).count() == 0 and pages.mode_offset(empty).count() == 0


def test_layout(spark):
    line = lambda t, y, x0=50.0, x1=550.0, size=10.0: (1, 600.0, 800.0, t, x0, y, x1, y + 10, size)
    rows = [line("첫째 문단이다.", 100.0), line("이어진다.", 112.0), line("둘째 문단이다.", 200.0), line("12", 780.0, 290.0, 310.0), line("작은 주석", 300.0, 50.0, 200.0, 6.0)]
    df = spark.createDataFrame(rows, "page_id bigint, width double, height double, text string, x0 double, y0 double, x1 double, y1 double, size double")
    got = [(r.lane, r.raw) for r in layout.passages(df).orderBy("ordinal").collect()]
    assert got == [("body", "첫째 문단이다.\n이어진다."), ("body", "둘째 문단이다."), ("note", "작은 주석"), ("margin", "12")]
    assert layout.passages(df.limit(0)).count() == 0


def test_copied_share(spark):
    notes = spark.createDataFrame([(1, "p", "가나다라마바사아자차카타파하거너더러머버" + "xyz"), (2, "p", "짧다"), (3, "q", None)], "id int, page string, note string")
    source = spark.createDataFrame([("p", "앞가나다라마바사아자차카타파하거너더러머버뒤")], "page string, source string")
    got = {r.id: round(r.share, 3) for r in evaluate.copied_share(notes, source, "id", "page", "note", "source").collect()}
    assert got == {1: round(20 / 23, 3), 2: 0.0, 3: 0.0}


#: Sentences and how plainly they define a term.
LONGER = ["동격관형사절", "관계관형사절"]


@pytest.mark.parametrize(("sentence", "key", "longer", "want"), [
    ("절이 관형사화되어 관형어로서 쓰이게 되면 그 절을 관형사절이라고 부른다.", "관형사절", LONGER, 10),
    ("관형사절은 용언 어간에 관형사형 어미가 붙어서 관형어로 쓰일 수 있는 절이다.", "관형사절", LONGER, 7),
    ("일반적으로 관형사절은 동격 관형사절과 관계 관형사절로 분류된다.", "관형사절", LONGER, 5),
    ("동격 관형사절이란 한 문장의 모든 필수 성분을 완전하게 갖추고 있는 관형사절이다.", "관형사절", LONGER, 2),
    ("우리 책에서도 ‘넓은’을 관형사절로 다룬다.", "관형사절", LONGER, 1),
    ("명사절은 명사화되어 명사가 쓰일 수 있는 자리에 오는 절이다.", "관형사절", LONGER, 0),
    ("이 때 발생하는 것이 ‘대화 함축’이다.", "대화함축", (), 9),
    ("대화 함축이란 협력하고 있다고 가정할 때 발생하는 숨겨진 의미이다(오주영，1997 ; 구현정，2001).", "대화함축", (), 10),
    ("위의 네 가지 격률 가운데 첫 번째 양의 격률은 필요한 만큼만 정보를 제공하라는 것이다.", "양의격률", (), 7),
    ("현시적 교수법은 명확한 행동적 목표를 기반으로 하는 교사 중심 지도법을 일 걷는다.", "현시적교수법", (), 9),
    ("평서형， 의문형， 명령형， 청유형， 감탄형을 묶어서 ‘종결형’ 이라고 하며 나머지는 비종결형이라고 한다.", "종결형", (), 10),
    ("가장 긴 드라마는 연속극이며， 가장 짧은 드라마는 단막극이다.", "드라마", (), 1),
    ("심리학적 기능이란 시인과 독자 사이의 관계에 작용한다.", "심리학적기능", (), 5),
    ("내리 쓰기 전략은 개요 짜기의 결과물을 보면서 하는 것이 일반적이다.", "내리쓰기전략", (), 5),
    ("현대 국어에서 두음 법칙이라고 부르는 현상이 왜 발생했는지는 설명하기 어렵다.", "두음법칙", (), 1),
    ("이것을 음소 분석이라고 부른다.", "분석", (), 1),
    ("문장 자체의 변화를 통해 부각하는 표현을 강조의 방법이라 한다.", "방법", (), 1),
    ("‘-가’， ‘-고’가 보조사라고 한다고 해서 문제가 해결되는 것은 아니다.", "보조사", (), 1),
    ("그러므로 이는 ‘모절(안은절)’이라고 불러야 한다.", "모절", (), 1),
    ("아리스토텔레스는 『시학』에서 예술가는 행동하는 인간을 모방한다고 말한다.", "아리스토텔레스", (), 5),
    ("소설을 가르치는 과정에서는 이야기의 뜻을 찾아가는 작업이 이루어지기 때문이다.", "에서", (), 1),
    ("이것을 음운이라고 하기도 한다.", "음운", (), 10), ("이에 비해 음운은 뜻을 구별하는 소리의 단위이다.", "음운", (), 7), (None, "음운", (), 0), ("", "", (), 0),
])
def test_definitions(sentence, key, longer, want):
    assert terms.definition_score_of(sentence, key, longer) == want


@pytest.mark.parametrize(("text", "want"), [
    ("'국물'이 [궁물]로 소리 난다.", [("국물", "궁물", ["비음화"])]), ("국물[궁물]과 솜이불[솜니불]", [("국물", "궁물", ["비음화"]), ("솜이불", "솜니불", ["ㄴ 첨가"])]),
    ("'국물'을 '궁물'로 발음한다", [("국물", "궁물", ["비음화"])]), ("국물 → 궁물", [("국물", "궁물", ["비음화"])]), ("국물이 [궁물]로", [("국물", "궁물", ["비음화"])]), ("아무것도 없다", []), (None, []),
])
def test_pronunciations(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "id int, t string")
    assert sorted((r.spelling, r.said, r.changes) for r in hangul.named_changes(rows, "t", "id").collect()) == sorted(want)


def test_gaps_across_blocks(spark, monkeypatch):
    rows = [("b", p, n) for p, n in [(1, None), (2, 1), (3, None), (5, None), (9, 8), (10, None), (11, 20), (12, None)]]
    df = spark.createDataFrame(rows, "book_id string, pdf_page int, printed_page int")
    want = None
    for size in (4096, 3, 1):
        monkeypatch.setattr(pages, "BLOCK", size)
        got = sorted((r.pdf_page, r.number, r.status) for r in pages.gap_fill(df).collect())
        want = want or got
        assert got == want
    assert want == [(1, None, None), (2, 1, "confirmed"), (3, 2, "offset"), (5, 4, "offset"), (9, 8, "confirmed"), (10, None, None), (11, 20, "confirmed"), (12, None, None)]
