"""Golden values of the scalar functions."""

from pyspark.sql import functions as F

from tariffspark.functions import text as T
from tariffspark.functions.similarity import ratio, token_set_ratio


def test_retail_prices(col):
    assert col(["12 500,00 ₸", "3 500,50", "бесплатно", "0", "10.002", None], T.col_parse_price("v")) == [12500, 3500.5, None, None, 10.002, None]


def test_archive_prices(col):
    assert col(["10 002", "10.002", "2099.5", "16 380 ₸", "1 410,50", "1.410,50", "999999999"], T.col_parse_price_archive("v")) == [10002, 10002, 2099.5, 16380, 1410.5, 1410.5, None]


def test_codes(col):
    assert col(["В02.110.002 кровь", "A02.020.000.2", "без кода", None], T.col_norm_code("v")) == ["B02.110.002", "A02.020.000", None, None]


def test_clean(col):
    assert col(["Общий анализ крови (5 параметров)", "  A-b_c ", ""], T.col_clean("v")) == ["общий анализ крови", "a b_c", ""]


def test_line_gate(col):
    kinds = col(["Направление на анализы", "Пациент: Тестовый", "12.03.2024", "ОАК", "Сдать натощак", "x", "анализ 12.03.2024"], T.col_classify_line("v")["kind"])
    assert kinds == ["noise", "noise", "noise", "service", "noise", "noise", "service"]


def test_panels(col):
    got = col(["Липидограмма", "Билирубин общий + прямой + непрямой", "Профиль: АЛТ, АСТ", "ОАК"], T.col_decompose("v"))
    assert [len(x) if x else None for x in got] == [4, 3, 2, None]


def test_specimen(col):
    assert col(["Кал на скрытую кровь", "Калий", "Кальций", "Глюкоза в моче", "Мокрота", None], T.col_specimen("v")) == ["stool", None, None, "urine", "sputum", None]


def test_variants(col):
    assert col(["Глюкоза в моче", "Глюкоза (в крови)", "Повторный приём гинеколога"], T.col_base_key("v")) == ["глюкоза", "глюкоза", "приём гинеколога"]
    assert col(["Глюкоза в моче", "Повторный приём гинеколога", "ОАК"], T.col_variant_label("v")) == ["моча", "повторный", "ОАК"]


def test_visits(col):
    assert col(["вторичный приём", "online", "детский врач", "приём"], T.col_visit_modifier("v")) == ["repeat", "online", "pediatric", None]
    assert col(["Приём гинеколога"], T.col_derive_visit_name("v", F.lit("repeat"))) == ["Повторный приём гинеколога"]


def test_categories(col):
    assert col(["УЗИ почек", "Приём терапевта", "Массаж", "Глюкоза", ""], T.col_category_enum(F.lit(None).cast("string"), F.lit(""), "v")) == ["диагностика", "приём врача", "процедура", "лаборатория", "лаборатория"]
    assert col(["тенге", "$", None, "?"], T.col_currency("v")) == ["KZT", "USD", "KZT", "KZT"]


def test_places(col):
    assert col(["Усть-Каменогорск", "Щучинск"], T.col_slugify("v")) == ["ust-kamenogorsk", "schuchinsk"]
    assert col(["ust-nation 3", "almaty"], T.col_title("v")) == ["Ust-Nation 3", "Almaty"]
    assert col(["ул. Абая 10", "сеть лабораторий", "г. Астана", None], T.col_is_geocodable("v")) == [True, False, False, False]


def test_similarity():
    assert ratio("", "") == 100 and ratio("abc", "abc") == 100
    assert token_set_ratio("ттг", "ттг гормон") == 100
    assert token_set_ratio("", "a") == 0
    assert round(ratio("abcd", "abxd"), 1) == 75.0
    assert 0 < token_set_ratio("глюкоза крови", "глюкоза мочи") < 100
