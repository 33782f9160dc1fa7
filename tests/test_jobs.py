"""Small goldens of the table operators and sources."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tariffspark.functions import text as T
from tariffspark.operators import compare as C
from tariffspark.operators import dedup as D
from tariffspark.operators import match as M
from tariffspark.operators import review as V
from tariffspark.sources import files as X

DAY = dt.date(2024, 5, 1)


def prices(spark, rows):
    """rows: id, clinic_id, service_id, source_type, price, valid_from."""
    return spark.createDataFrame([(i, c, s, t, Decimal(p), 1.0, v) for i, c, s, t, p, v in rows], "id long, clinic_id long, service_id long, source_type string, price decimal(12,2), match_confidence double, valid_from date")


def test_source_priority(spark):
    old = prices(spark, [(1, 1, 1, "web_scrape", 2000, DAY), (2, 1, 2, "upload", 2500, DAY), (3, 1, None, "api", 5, DAY)])
    new = prices(spark, [(10, 1, 1, "upload", 2500, DAY), (11, 1, 2, "web_scrape", 1900, DAY), (12, 1, 3, "api", 10, DAY)])
    got = {r.service_id: (float(r.price), r.change) for r in D.upsert_prices(old, new).collect()}
    assert got == {1: (2500.0, "updated"), 2: (2500.0, "kept"), None: (5.0, "kept"), 3: (10.0, "inserted")}


def test_trend(spark):
    h = spark.createDataFrame([(1, Decimal(2000), DAY), (1, Decimal(2200), DAY), (1, Decimal(2400), dt.date(2024, 6, 1)), (1, Decimal(2600), dt.date(2024, 6, 1)), (2, Decimal(5), DAY)], "service_id long, price decimal(12,2), recorded_at date")
    r = D.price_trend(h).collect()
    assert [(x.service_id, x.first, x.last, x.change_pct, x.direction) for x in r] == [(1, 2100.0, 2500.0, 19.0, "up")]


def test_freshness(spark):
    p = spark.createDataFrame([(1, None, dt.date(2024, 4, 20), None), (2, False, dt.date(2024, 4, 20), None), (3, True, dt.date(2024, 1, 1), None), (4, None, None, None), (5, None, None, dt.date(2024, 4, 30))], "id int, is_active boolean, parsed_at date, valid_from date")
    assert {r.id: r.is_fresh for r in C.with_fresh(p, "2024-05-01").collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_history_records_changes_only(spark):
    empty = spark.createDataFrame([], "id long, clinic_id long, service_id long, price decimal(12,2), recorded_at date")
    ups = spark.createDataFrame([(i, 1, 1, Decimal(p), DAY) for i, p in enumerate((2000, 2000, 2500))], empty.schema)
    assert [float(r.price) for r in V.append_history(empty, ups).orderBy("id").collect()] == [2000.0, 2500.0]


def test_duplicate_runs(spark):
    p = spark.createDataFrame([(1, 1, "a", None), (1, 1, "b", None), (1, 2, "b", None), (1, 2, "a", None), (1, 2, "c", 5), (1, 3, "a", None)], "clinic_id long, run_id long, raw_name string, service_id long")
    assert [(r.run_id, r.names) for r in D.duplicate_runs(p).collect()] == [(1, 2)]


CATALOG = [(1, "Общий анализ крови", "Анализы", ["ОАК", "CBC"]), (2, "Глюкоза (в крови)", "Анализы", ["глюкоза", "glucose"]), (3, "Глюкоза в моче", "Анализы", []), (4, "Приём гинеколога", "Приём врача", []), (5, "Общий анализ мочи", "Анализы", ["ОАМ"])]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "id long, canonical_name string, category string, synonyms array<string>").withColumn("tarificator_code", F.lit(None).cast("string")).withColumn("specialty", F.lit(""))


def test_strict_match(spark):
    s = catalog(spark)
    items = spark.createDataFrame(list(enumerate(["Глюкоза", "ОАК", "вторичный приём гинеколога", "qwerty zzz", "глюкозотолерантный тест глюкоза"])), "item_id long, raw_name string")
    got = {r.item_id: (r.canonical, r.status) for r in M.match_one(items, M.build_dictionary(s), s).collect()}
    assert got[0][0] == "Глюкоза (в крови)" and got[1][0] == "Общий анализ крови"
    assert got[2][0] == "Повторный приём гинеколога" and got[3] == ("—", "unmatched")
    assert got[4][0] == "Глюкозотолерантный тест"


def test_lines(spark):
    s = catalog(spark)
    lines = spark.createDataFrame([(1, "ОАК, ОАМ"), (2, "Общий анализ крови, 5 diff"), (3, "Пациент: Иванов"), (4, "Липидограмма")], "line_id long, text string")
    rows = M.analyze_lines(lines, M.build_dictionary(s), s).collect()
    n = {i: [r.canonical for r in rows if r.line_id == i] for i in (1, 2, 3, 4)}
    assert sorted(n[1]) == ["Общий анализ крови", "Общий анализ мочи"] and n[2] == ["Общий анализ крови"] and n[3] == [None] and len(n[4]) == 4


def test_csv_by_delimiter(spark):
    t = spark.createDataFrame([(1, "Услуга;Цена\nПриём, первичный;7000\nОАК;3200\nУЗИ, почек;4500"), (2, "Название,Цена\nОАК,2200")], "doc_id long, text string")
    got = sorted((r.doc_id, r.price) for r in X.items_from_csv_text(t).collect())
    assert got == [(1, 3200.0), (1, 4500.0), (1, 7000.0), (2, 2200.0)]


def test_grid(spark):
    g = spark.createDataFrame([(1, "s", 0, ["Прейскурант", "", "", ""]), (1, "s", 1, ["Код", "Наименование услуг", "Цена для граждан РК", "Цена для нерезидентов"]), (1, "s", 2, ["В02.110.002", "Общий анализ крови", "880", "1410"]), (1, "s", 3, ["B02.110.003", "Глюкоза в сыворотке", "1 000", "1 500"])], "doc_id long, sheet string, row_idx int, cells array<string>")
    got = {r.code: (r.price_resident, r.price_nonresident) for r in X.items_from_grid(g).collect()}
    assert got == {"B02.110.002": (880.0, 1410.0), "B02.110.003": (1000.0, 1500.0)}


def _plain_grid(rows):
    """One sheet by the rules, in plain Python: rows of (row_idx, cells) -> {(row_idx, name, price)} where no code or second price stands."""
    import re

    from tariffspark.functions import rules as R

    has = lambda text, words: any(w in text for w in words)
    low = lambda c: (c or "").strip(" ").lower()
    letters = lambda c: len([x for x in low(c) if x.isalpha()])
    digits = lambda c: re.sub(r"\s", "", (re.search(r"[0-9][0-9\s]*", c or "") or [""])[0])
    priced = lambda c: letters(c) <= 4 and digits(c) != "" and int(digits(c)) > 0
    first = [i for i in sorted({i for i, cells in rows if cells})][:25]
    of = {i: [(k, c) for j, cells in rows if j == i and cells for k, c in enumerate(cells)] for i in {i for i, _ in rows}}
    every = R.NAME_HINTS, R.CODE_HINTS, R.PRICE_HINTS, R.RES_HINTS
    hints = {i: sum(any(has(low(c), w) for w in every) for _, c in of[i]) for i in first}
    heads = [i for i in first if hints[i] >= 2]
    head = min(heads, key=lambda i: (-hints[i], i)) if heads else None
    last = head
    if head is not None:
        last = max([i for i in first if head < i <= head + 2 and not any(priced(c) for _, c in of[i])], default=head)
    titles: dict = {}
    for i in sorted(of):
        if head is not None and head <= i <= last:
            for k, text in sorted(((k, low(c)) for k, c in of[i]), key=lambda x: x[1]):
                titles[k] = (titles[k] + " " if k in titles else "") + text
    roles: dict = {}
    for k, text in titles.items():
        code, price, name = has(text, R.CODE_HINTS), has(text, R.PRICE_HINTS), has(text, R.NAME_HINTS)
        r = "code" if code and not price and not name else "nonres" if has(text, R.NONRES_HINTS) else "res" if has(text, R.RES_HINTS) else "price" if price else "name" if name else None
        if r:
            roles[r] = min(roles.get(r, k), k)
    body = [(k, c) for i in of if last is None or i > last for k, c in of[i]]
    cols: dict = {}
    for k, c in body:
        cols.setdefault(k, []).append(c)
    share = {k: sum(map(priced, x)) / len(x) for k, x in cols.items()}
    width = {k: sum(map(letters, x)) / len(x) for k, x in cols.items()}
    g_price = max([(v, k) for k, v in share.items() if v > 0.3], default=(0, None))[1]
    g_name = -max([(v, -k) for k, v in width.items() if v > 0], default=(0, 1))[1]
    if g_name < 0:
        return set()
    at = lambda cells, k: cells[k] if cells and k is not None and k < len(cells) else None
    out = set()
    for i, cells in rows:
        if last is None or i > last:
            name = (at(cells, roles.get("name", g_name)) or "").strip(" ")
            p = roles.get("price", g_price) if "res" not in roles and "nonres" not in roles else roles.get("res", roles.get("price"))
            price, other = digits(at(cells, p)), digits(at(cells, roles.get("nonres")))
            if len(name) >= 4 and letters(name) >= 4 and (price or other):
                out.add((i, name, float(price) if price else None, float(other) if other else None))
    return out


def test_grids_by_plain_rules(spark):
    """Sheets with and without headers, continued and repeated ones, short and empty rows, against the rules in Python."""
    r = random.Random(4)
    words = ["биопсия", "рентген кисти", "осмотр глаз", "пункция", "массаж спины", "", None]
    titles = ["Код", "Наименование услуг", "Цена", "Цена для граждан РК", "Цена для нерезидентов", "Стоимость, тенге", "№", "прочее", ""]
    sheets = {}
    for n in range(60):
        rows, wide = [], r.randint(2, 5)
        for i in range(r.randint(1, 40)):
            kind = r.random()
            if kind < 0.08 or (i == 2 and n % 3):
                cells = [r.choice(titles) for _ in range(wide)]
            elif kind < 0.12:
                cells = r.choice([[], None, ["только имя"]])
            else:
                cells = [r.choice(words) if k % 2 else str(r.randint(100, 9000)) for k in range(wide)]
            rows.append((i + r.randint(0, 1), cells))
        sheets[n] = rows
    data = [(n, "s", i, cells) for n, rows in sheets.items() for i, cells in rows]
    got: dict = {}
    for x in X.items_from_grid(spark.createDataFrame(data, "doc_id long, sheet string, row_idx int, cells array<string>")).collect():
        got.setdefault(x.doc_id, set()).add((x.row_idx, x.name, x.price_resident, x.price_nonresident))
    want = {n: rows for n, rows in ((n, _plain_grid(rows)) for n, rows in sheets.items()) if rows}
    assert len(want) > 30 and got == want


def test_html_rows(spark):
    h = spark.createDataFrame([(1, "<table><tr><td>1</td><td>Приём терапевта</td><td>8 000 ₸</td></tr><tr><td>2</td><td>УЗИ почек</td><td>6000</td></tr></table>"), (2, "<ul><li>ОАК — 2500 тг</li></ul>")], "page_id long, html string")
    assert sorted((r.id, r.raw_name, r.price) for r in X.items_from_html(h).collect()) == [(1, "Приём терапевта", 8000.0), (1, "УЗИ почек", 6000.0), (2, "ОАК", 2500.0)]


def test_empty_tables(spark):
    p = prices(spark, []).limit(0)
    assert D.dedup_min_price(p).count() == 0 and D.service_summary(p).count() == 0


def test_semantic_tier(spark):
    """Names that letters do not match, with vectors: the nearest service from 0.72 on, but not one of another specimen."""
    s = catalog(spark)
    names = ["qwerty zzz", "uiop asdf", "сахар мочи вечером"]
    items = spark.createDataFrame(list(enumerate(names)), "item_id long, raw_name string")
    q = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "q long, v array<double>")
    c = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.7, -0.7])], "c long, v array<double>")
    got = {r.item_id: (r.service_id, r.confidence) for r in M.match(items, M.build_dictionary(s), s, (q, c)).collect()}
    assert got[0][0] == 2 and abs(got[0][1] - 1 / 1.01**0.5) < 1e-9
    assert got[1][1] < 0.72
    one = {r.item_id: (r.method, r.service_id) for r in M.match_one(items, M.build_dictionary(s), s, (q, c)).collect()}
    assert one[0] == ("semantic", 2) and one[1][0] == "none"
    how = {r.item_id: r.method for r in M.normalize(items, s, (q, c))[0].collect()}
    assert how[0] == "semantic" and how[1] == "new"
    shown = {r.item_id: (r.method, r.service_id) for r in M.preview(items, M.build_dictionary(s), s, (q, c)).collect()}
    assert shown[0] == ("semantic", 2)
    pool = {(r.item_id, r.service_id) for r in M.review_candidates(items, s, (q, c)).collect()}
    assert {(0, 2), (1, 2), (2, 2)} <= pool


def test_given_decisions(spark):
    s = catalog(spark)
    items = spark.createDataFrame([(1, "qwerty zzz"), (2, "uiop asdf")], "item_id long, raw_name string")
    d = spark.createDataFrame([("qwerty zzz", 4, None, None, 0.9), ("uiop asdf", None, "Новая услуга", "УЗИ", 0.8)], "raw_name string, match_id long, canonical string, category string, confidence double")
    matched, made, learned = M.normalize(items, s, decisions=d)
    got = {r.item_id: (r.service_id, r.method, r.is_new) for r in matched.collect()}
    new = made.collect()
    assert got[1] == (4, "decision", False) and got[2][1:] == ("decision", True)
    assert [(r.canonical_name, r.category) for r in new] == [("Новая услуга", "УЗИ")] and got[2][0] == new[0].id
    assert {r.service_id: r.learned for r in learned.collect()}[4] == ["qwerty zzz"]


def test_search_suggest_and_questions(spark):
    s = catalog(spark)
    q = spark.createDataFrame([(1, "глюкоза"), (2, "общий")], "query_id long, query string")
    names = [(r.query_id, r.canonical_name) for r in M.suggest(q, s).orderBy("query_id", "place").collect()]
    assert names[0] == (1, "Глюкоза (в крови)") and {n for i, n in names if i == 2} == {"Общий анализ крови", "Общий анализ мочи"}
    asked = spark.createDataFrame([(1, "сколько стоит общий анализ крови?"), (2, "zzz")], "question long, text string")
    got = [(r.question, r.service_id) for r in M.rank_services(asked, s, M.build_dictionary(s)).collect()]
    assert (1, 1) in got and all(i == 1 for i, _ in got)


def test_service_lines(spark):
    rows = [(1, "ОАК, 12.06"), (2, "АЛТ/АСТ"), (3, "глюкоза + холестерин\n1) ОАМ;  УЗИ   почек."), (4, "Пациент: Иванов\n12"), (5, "\n".join(f"анализ номер-{chr(1072 + i)}бв" for i in range(32))), (6, None)]
    got = {}
    for r in X.extract_service_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got[1] == ["ОАК"] and got[2] == ["АЛТ", "АСТ"] and got[3] == ["глюкоза", "холестерин", "ОАМ", "УЗИ почек"]
    assert 4 not in got and 6 not in got and len(got[5]) == 30


def test_city_in_any_case(spark):
    cities = spark.createDataFrame([("Караганда",), ("Астана",), ("Алматы",), ("Тараз",)], "name string")
    t = spark.createDataFrame([(1, "узи в Караганде"), (2, "из Астаны"), (3, "лаборатория олматы"), (4, "ничего"), (5, "тараз, алматы"), (6, None)], "doc_id long, text string")
    got = {r.doc_id: r.city for r in X.detect_city(t, cities).collect()}
    assert {i: got.get(i) for i in (1, 2, 3, 4, 6)} == {1: "Караганда", 2: "Астана", 3: "Алматы", 4: None, 6: None} and got[5] in ("Тараз", "Алматы")


def test_json_keys_in_order(spark):
    rows = [(1, '[{"атауы": "Общий анализ", "бағасы": 2500}]'), (2, '[{"service_name": "later", "title": "first one", "value": 7, "цена": 9}]'), (3, '[{"name": null, "title": "never seen", "price": 5}]')]
    got = {r.doc_id: (r.raw_name, r.price) for r in X.items_from_json(spark.createDataFrame(rows, "doc_id long, payload string")).collect()}
    assert got == {1: ("Общий анализ", 2500.0), 2: ("first one", 9.0)}


def test_html_rows_once(spark):
    row = "<tr><td>1</td><td>Приём терапевта</td><td>8 000</td></tr>"
    h = spark.createDataFrame([(1, f"<table>{row}{row.replace('Приём', 'ПРИЁМ')}</table>")], "page_id long, html string")
    assert [(r.raw_name, r.price) for r in X.items_from_html(h).collect()] == [("Приём терапевта", 8000.0)]


def test_stream_batches_keep_state(spark, tmp_path):
    """Two files, two micro-batches: the second finds what the first has written."""
    from tariffspark.streaming import jobs as S

    kind = "item_id long, clinic_id long, raw_name string, source_type string, price decimal(12,2), valid_from date"
    for n, row in enumerate([(1, 7, "ОАК", "upload", Decimal(2500), DAY), (2, 7, "ОАК", "web_scrape", Decimal(1900), DAY)]):
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = S.PriceTable(spark, str(tmp_path / "prices"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.ingest(stream, catalog(spark), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert table.commits() == [0, 1] and [(r.service_id, float(r.price), r.source_type) for r in table.read().collect()] == [(1, 2500.0, "upload")]


def test_archive_listing(spark, tmp_path):
    import zipfile

    (tmp_path / "прайс.csv").write_text("a;b")
    (tmp_path / "readme.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "все.zip", "w") as z:
        z.writestr("x/лист.xlsx", b"PK")
        z.writestr("справочник.xlsx", b"PK")
    assert sorted((r.name, r.format) for r in X.list_archive(spark, str(tmp_path)).collect()) == [("лист.xlsx", "xlsx"), ("прайс.csv", "csv")]


def test_key_search_equals_brute_force():
    import random

    from tariffspark.functions.similarity import _Keys, token_set_ratio

    rnd = random.Random(5)
    words = ["глюкоза", "глюкозы", "кровь", "крови", "моча", "общий", "анализ", "узи", "t3", "t4", "ferritin", "feritin", "a", "ab"]
    name = lambda: " ".join(rnd.choice(words) if rnd.random() < 0.8 else "".join(rnd.choices("abвг", k=rnd.randint(1, 9))) for _ in range(rnd.randint(0, 6)))
    keys = list(dict.fromkeys(name() for _ in range(300)))
    block = _Keys(keys, list(range(len(keys))))
    for _ in range(200):
        n, k = name(), rnd.choice([1, 3, 12])
        scores = [(-token_set_ratio(n, x), i) for i, x in enumerate(keys)]
        assert block.top(n, k) == [(i, -s) for s, i in sorted(scores)[:k]]
        assert sorted(block.above(n, 88)) == sorted((i, -s) for s, i in scores if s <= -88)
    assert _Keys([], []).top("a", 3) == [] == _Keys([], []).above("a", 3)


def test_relevance_tiers_and_typos(spark):
    s = spark.createDataFrame([(1, "Глюкоза", ["сахар крови"]), (2, "Ферритин", []), (3, "Общий анализ крови", None)], "id long, canonical_name string, synonyms array<string>")
    q = spark.createDataFrame([(1, "глюкоза"), (2, "Сахар крови"), (3, "крови"), (4, "глю"), (5, "сах"), (6, "р крови"), (7, "феритин"), (8, "фер"), (9, " "), (10, None), (11, "анализ крови общий")], "query_id long, query string")
    got = {(r.query_id, r.service_id): round(r.score, 2) for r in M.relevance(q, s).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 0.97, (3, 1): 0.88, (3, 3): 0.92, (4, 1): 0.84, (5, 1): 0.78, (6, 1): 0.72, (7, 2): 0.93, (8, 2): 0.84, (11, 3): 1.0}
    assert (7, 2) not in {(r.query_id, r.service_id) for r in M.relevance(q, s, typos=False).collect()}
    assert M.relevance(q, s.limit(0)).count() == 0 == M.relevance(q.limit(0), s).count()


def test_names_inside_texts(spark):
    a = spark.createDataFrame([("abcd",), ("abc",), ("abcdefghijklmnop",), ("bcde",)], "s string")
    b = spark.createDataFrame([("xxabcdefghijklmnopyy",), ("abce",), ("ab",), (None,)], "t string")
    got = {(r.s, r.t) for r in M.held_in(a, b, "s", "t", 4).collect()}
    assert got == {(x, "xxabcdefghijklmnopyy") for x in ("abcd", "abcdefghijklmnop", "bcde")}


def test_cosine_of_two_sides_of_one_table(spark):
    from tariffspark.functions.similarity import cosine_topk

    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, v array<double>")
    got = cosine_topk(e.select(F.col("id").alias("q"), "v"), e.select(F.col("id").alias("c"), "v"), 1, block=2).collect()
    assert {(r.q, r.c) for r in got} == {(i, i) for i in range(6)}


def test_card_hours(spark):
    spec = '[{"dayOfWeek":["https://schema.org/Monday","Tuesday"],"opens":"08:00:00","closes":"16:00"},{"dayOfWeek":"Monday","opens":"09:00","closes":"16:00"},{"dayOfWeek":"Holiday","opens":"1","closes":"2"},{"dayOfWeek":"Sunday","closes":"2"}]'
    page = lambda x: f'<script type="application/ld+json">{{"name":"A"{x}}}</script>'
    df = spark.createDataFrame([(1, page(f',"openingHoursSpecification":{spec}')), (2, page("")), (3, page(',"openingHoursSpecification":"by day"'))], "page_id long, html string")
    assert {r.page_id: r.working_hours for r in X.business_cards(df).collect()} == {1: "Пн 09:00–16:00, Вт 08:00–16:00", 2: "", 3: ""}


def test_chain_branches(spark):
    df = spark.createDataFrame([(1, "https://kdl-3.x.kz https://med.x.kz https://INVITRO-1.x.kz https://invitro-12.x.kz https://kdl-3.x.kz")], "page_id long, html string")
    assert [r.slug for r in X.extract_slugs(df, "html", "x.kz", chains=True).orderBy("pos").collect()] == ["kdl-3", "invitro-12"]


def test_families_and_siblings(spark):
    from tariffspark.operators import compare as C
    from tariffspark.operators import dedup as D

    s = spark.createDataFrame([(1, "Ферритин"), (2, "ферритин"), (3, "ФЕРРИТИН"), (4, "УЗИ"), (5, "ферритин"), (6, None)], "id long, canonical_name string")
    p = spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 3.0), (3, 9.0), (4, 1.0), (6, 2.0), (None, 1.0)], "service_id long, price double")
    got = {r.service_id: (r.offers_count, r.min_price, r.siblings, r.cheapest_sibling) for r in D.variant_families(s, p).collect()}
    assert got == {1: (2, 3.0, 2, 2), 2: (1, 3.0, 2, 1), 3: (1, 9.0, 2, 1), 4: (1, 1.0, 0, None), 6: (1, 2.0, 0, None)}
    asked = spark.createDataFrame([(5,), (2,), (4,), (99,), (2,)], "id long")
    assert sorted((r.id, r.service_id) for r in D.variant_siblings(s, p, asked).collect()) == [(2, 1), (2, 3), (5, 1), (5, 2), (5, 3)]
    assert D.variant_families(s.limit(0), p).count() == 0 == D.variant_families(s, p.limit(0)).count()
    top = C.leaders(spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 3.0), (2, 1.0), (None, 4.0), (None, 5.0), (3, None), (3, None)], "g long, v double"), ["g"], "v").collect()
    assert sorted((r.g or 0, r.v) for r in top) == [(0, 4.0), (1, 2.0), (1, 2.0)]


def test_key_blocks_and_parts(spark, monkeypatch):
    from tariffspark.functions import similarity as S

    monkeypatch.setattr(S, "PART", 7)
    keys = [f"k{i} w{i % 5}" for i in range(40)]
    d = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, place long")
    names = [f"w{i % 5} k{i + 3} x" for i in range(30)] + [None, "", "k1 w1"]
    n = spark.createDataFrame([(x,) for x in names + names], "key string")
    want = {(x, i): -s for x in set(names) - {None} for s, i in sorted((-S.token_set_ratio(x, k), i) for i, k in enumerate(keys))[:3]}
    assert {(r.name, r.place): r.score for r in S.top_keys(n, d, 3, block=11).collect()} == want
    assert S.top_keys(d, d, 1, block=11).where("score = 100").count() == 40
    assert S.top_keys(n, d.limit(0), 3).count() == 0 == S.top_keys(n.limit(0), d, 3).count()


def test_key_search_grows_slower_than_the_keys():
    """Names against invented catalogs: equal to every score sorted, and few keys are compared letter by letter."""
    import random

    from tariffspark.functions import similarity as S

    rnd = random.Random(3)
    words = ["".join(rnd.choice(["he", "mo", "glo", "bin", "tri", "ser", "um", "ane", "lip", "tox", "ri", "kar"]) for _ in range(rnd.randint(2, 4))) for _ in range(1500)]
    compared = []
    for n in (500, 4000):
        keys = sorted({" ".join(rnd.choices(words, [1 / (i + 1) ** 0.7 for i in range(len(words))], k=rnd.randint(2, 5))) for _ in range(n)})
        index = S._Keys(keys, list(range(len(keys))))
        for key in rnd.sample(keys, 20):
            name = key[:3] + "x" + key[3:] + (" и очень длинное пояснение к названию услуги, длиннее шестидесяти четырёх букв" if len(key) % 5 == 0 else "")
            want = [(i, -s) for s, i in sorted((-S.token_set_ratio(name, x), i) for i, x in enumerate(keys))[:5]]
            assert index.top(name, 5) == want
            assert index.above(name, 80.0) == [(i, S.token_set_ratio(name, x)) for i, x in enumerate(keys) if S.token_set_ratio(name, x) >= 80.0]
        compared.append(index.compared / 40 / len(keys))
    assert compared[1] < compared[0] < 0.5


def test_cosine_skips_far_clusters(spark):
    import numpy as np

    from tariffspark.functions.similarity import cosine_topk

    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.15 * rnd.normal(size=16)).tolist()) for i in range(600)] + [(600, [0.0] * 16), (601, rows0 := [1.0] + [0.0] * 15), (602, rows0), (603, None)]
    asked = [(i, v) for i, v in rows if i % 7 == 0] + [(9000, [0.0] * 16), (9001, rows0)]
    c, q = spark.createDataFrame(rows, "c long, v array<double>"), spark.createDataFrame(asked, "q long, v array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    counts = {}
    for pivots, block in ((32, 1000), (5, 50)):
        got = {(r.q, r["rank"]): (r.c, round(r.score, 9)) for r in cosine_topk(q, c, 4, block=block, pivots=pivots, counts=counts).collect()}
        want = {}
        for i, v in asked:
            best = sorted((-round(float(unit(v) @ unit(w)), 9), j) for j, w in rows if w is not None)[:4]
            want |= {(i, n): (j, -s + 0.0) for n, (s, j) in enumerate(best, 1)}
        assert got == want
    counts = {}
    cosine_topk(q, c, 4, pivots=64, counts=counts).count()
    assert counts["compared"] < 0.4 * counts["all"]
    assert cosine_topk(q, c.limit(0), 4).count() == 0 == cosine_topk(q.limit(0), c, 4).count()


def test_equal_vectors_are_compared_once(spark):
    from tariffspark.functions.similarity import cosine_topk

    vec = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    rows = [(i, vec[i % 3]) for i in range(300)]
    c, q = spark.createDataFrame(rows, "c long, v array<double>"), spark.createDataFrame(rows + [(300, [0.0, 0.0])], "q long, v array<double>")
    counts = {}
    got = {(r.q, r["rank"]): r.c for r in cosine_topk(q, c, 4, counts=counts).collect()}
    assert len(got) == 4 * 301 and all(got[i, n] == i % 3 + 3 * (n - 1) for i in range(300) for n in (1, 2, 3, 4))
    assert [got[300, n] for n in (1, 2, 3, 4)] == [0, 1, 2, 3]  # all score 0
    assert counts["all"] == 4 * 3 and counts["compared"] <= 4 * 3


def test_best_scores_of_a_task():
    import numpy as np
    import pandas as pd

    from tariffspark.functions.similarity import ROWS, _best, _slices

    score, place = _best(np.array([[0.5, 0.9, 0.5, 0.9], [-np.inf, 0.0, np.nan, -0.0]]), np.array([[7, 5, 2, 3], [9, 4, 8, 1]]), 3)
    assert place.tolist() == [[3, 5, 2], [8, 1, 4]] and score[0].tolist() == [0.9, 0.9, 0.5]
    lengths = [len(x) for x in _slices(iter([pd.DataFrame({"v": range(2 * ROWS + 1)}), pd.DataFrame({"v": []})]))]
    assert lengths == [ROWS, ROWS, 1]


def test_vectors_are_not_shuffled_for_their_answers(spark):
    from tariffspark.functions.similarity import cosine_topk

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(5, [0.0, 1.0]), (6, [-0.0, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, None)]
        v = spark.createDataFrame(rows, "id long, v array<float>")
        for k, want in ((1, {(5, 5), (6, 5), (7, 7), (8, 7)}), (2, {(5, 5), (5, 6), (6, 5), (6, 6), (7, 7), (7, 8), (8, 7), (8, 8)})):
            found = cosine_topk(v.select(F.col("id").cast("string").alias("q"), "v"), v.select(F.col("id").alias("c"), "v"), k)
            assert {(int(r.q), r.c) for r in found.collect()} == want
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(_v1" in plan and not any("q_v" in x.partition("hashpartitioning")[2] for x in plan.splitlines())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merge_plans_are_not_broadcast(spark):
    plan = spark.createDataFrame([(2, 1, None), (3, 2, 4)], "from_id long, to_id long, urine_id long")
    p = spark.createDataFrame([(i, i % 5, 1.0, "a") for i in range(20)], "id long, service_id long, price double, raw_name string")
    s = spark.createDataFrame([(i, f"s{i}", []) for i in range(5)], "id long, canonical_name string, synonyms array<string>")
    for out in (V.merge_canons(p, plan), V.merge_followers(p, plan, 5.0), V.merge_services(s, plan, p)):
        out.collect()
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_equal_queries_are_ranked_once(spark, monkeypatch):
    """Rankings see a row a distinct text and name, not one a query."""
    s = catalog(spark)
    q = spark.createDataFrame([(i, ("Глюкоза", " глюкоза ")[i % 2]) for i in range(500)], "query_id long, query string")
    seen = []
    monkeypatch.setattr(M, "first_by", lambda df, *by: seen.append(df.count()) or D.first_by(df, *by))
    got = M.suggest(q, s, typos=False).collect()
    one = {(r.canonical_name, r.score, r.place) for r in got if r.query_id == 0}
    assert one and len(got) == 500 * len(one) and all((r.canonical_name, r.score, r.place) in one for r in got)
    assert seen and max(seen) <= s.count()


def test_merge_chains_and_cycles(spark):
    """Chains end where they end, cycles and what leads into them merge nothing, in all four tables."""
    from tariffspark.operators import review as V

    n = 37
    chain = [(i, i + 1, 1000 if i == n - 1 else None) for i in range(1, n)]  # 1 -> 2 -> ... -> 37
    plan = spark.createDataFrame([*chain, (50, 51, None), (51, 52, None), (52, 50, None), (49, 50, None), (60, 60, None), (70, 1, 5), (80, 81, None), (80, 90, None), (None, 1, None), (99, None, None)], "from_id long, to_id long, urine_id long")
    got = {r.from_id: (r.to_id, r.urine_id) for r in V.close_plan(plan).collect()}
    assert got == {i: (n, 1000) for i in range(1, n)} | {70: (n, n), 80: (81, None)}
    prices = spark.createDataFrame([(i, s, name, Decimal(5)) for i, (s, name) in enumerate([(1, "Глюкоза"), (1, "Глюкоза в моче"), (50, "x"), (60, "x"), (n, "x"), (None, "x")])], "id long, service_id long, raw_name string, price decimal(12,2)")
    assert sorted((r.id, r.service_id) for r in V.merge_canons(prices, plan).collect()) == [(0, n), (1, 1000), (2, 50), (3, 60), (4, n), (5, None)]
    assert sorted(r.service_id for r in V.merge_followers(prices.where("service_id is not null"), plan).collect()) == [n, n, n, 50, 60]
    services = spark.createDataFrame([(i, f"s{i}", []) for i in (1, 2, n, 50, 51)], "id long, canonical_name string, synonyms array<string>")
    assert {r.id: r.synonyms for r in V.merge_services(services, plan, prices).collect()} == {n: ["s1", "s2", "Глюкоза"], 50: [], 51: []}
    assert V.close_plan(plan.limit(0)).collect() == []


def test_archives_inside_archives(spark):
    import io
    import zipfile

    def pack(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name.replace("__", "/").replace("_", "."), data)
        return out.getvalue()

    deep = pack(a__list_csv="1;2", inner_zip=pack(price_xlsx=b"PK", innermost_zip=pack(last_csv="x", readme_txt="r")))
    files = spark.createDataFrame([("d/deep.zip", "deep.zip", len(deep), bytearray(deep)), ("d/bad.zip", "bad.zip", 3, bytearray(b"abc")), ("d/x.csv", "x.csv", 1, bytearray(b"1")), ("d/empty.zip", "empty.zip", 0, bytearray(pack()))], "path string, name string, length long, content binary")
    rows = {r.path: (r.length, r.error is None) for r in X.archive_members(files).collect()}
    assert rows == {"d/deep.zip/a/list.csv": (3, True), "d/deep.zip/inner.zip/price.xlsx": (2, True), "d/deep.zip/inner.zip/innermost.zip/last.csv": (1, True), "d/deep.zip/inner.zip/innermost.zip/readme.txt": (1, True), "d/bad.zip": (3, False), "d/x.csv": (1, True)}
    assert sorted(r.name for r in X.price_files(X.archive_members(files)).collect()) == ["last.csv", "list.csv", "price.xlsx", "x.csv"]
    assert "d/deep.zip/inner.zip" in {r.path for r in X.archive_members(files, depth=1).collect()}


def test_city_names_slugs_and_aliases(spark):
    cities = spark.createDataFrame([("Алматы",), ("Астана",), ("Усть-Каменогорск",)], "name string")
    asked = ["almaty", "uk", "Nur-Sultan", "nursultan", "АСТАНА", "усть-каменогорск", "semei", "new town", "", None]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, city string")
    got = [r.city_name for r in X.canonical_city(df, cities).orderBy("i").collect()]
    assert got == ["Алматы", "Усть-Каменогорск", "Астана", "Астана", "Астана", "Усть-Каменогорск", "Semei", "New Town", None, None]


def test_search_without_a_query_and_by_category(spark):
    docs = spark.createDataFrame([(1, 3, "лаборатория"), (2, 0, "лаборатория"), (3, 1, "диагностика")], "service_id long, offers_count int, category_enum string")
    s = spark.createDataFrame([(1, "Beta", "Анализы", ["b"]), (2, "Alpha", "Анализы", []), (3, "Alpha scan", "МРТ/КТ", [])], "id long, canonical_name string, category string, synonyms array<string>")
    q = spark.createDataFrame([(1, None), (2, " "), (3, "alpha")], "query_id long, query string")
    got = lambda **more: sorted((r.query_id, r.place, r.service_id) for r in M.search(q, s, docs, **more).collect())
    assert got() == [(1, 1, 3), (1, 2, 1), (2, 1, 3), (2, 2, 1), (3, 1, 3)]
    assert got(n=1) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert got(category="Диагностика") == [(1, 1, 3), (2, 1, 3), (3, 1, 3)] and got(category="мрт") == got(category="Диагностика")
    assert got(category="анализ") == [(1, 1, 1), (2, 1, 1)]


def test_prices_are_read_from_one_look_at_a_cell(spark):
    df = spark.createDataFrame([("1 234,50 тг",), ("0",), (None,), ("1.234.567",)], "c string")
    for f, want in ((T.col_parse_price_archive, [1234.5, None, None, 1234567.0]), (T.col_parse_price, [1234.5, None, None, None])):
        priced = df.select(f("c").alias("p"))
        plan = priced._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") == 1
        assert [r.p for r in priced.collect()] == want


def test_short_names_found_whole_need_no_others(spark, monkeypatch):
    """Equal to the search among all keys; short names whose words a key holds, or that hold those of a key, do not come to it."""
    r = random.Random(8)
    words = ["кал", "моча", "кровь", "анализ", "тест", "узи", "почек", "гормон", *map(str, range(12))]
    names = sorted({" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(70)})
    s = spark.createDataFrame([(i, n, "Анализы", [r.choice(words)] if i % 5 == 0 else []) for i, n in enumerate(names)], "id long, canonical_name string, category string, synonyms array<string>")
    asked = sorted({" ".join(r.choices([*words, "гормны", "почка"], k=r.randint(1, 5))) for _ in range(90)} | {"", "тест тест 5", "анализ крови на гормоны с забором материала 3"})
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, raw_name string")
    d = M.build_dictionary(s)
    sent = []
    every = M.candidates
    monkeypatch.setattr(M, "candidates", lambda i, *a: sent.append(i.count()) or every(i, *a))
    got = sorted(map(tuple, M.match_guarded(items, d, s, 3).collect()), key=str)
    monkeypatch.setattr(M, "SHORT", -1)
    want = sorted(map(tuple, M.match_guarded(items, d, s, 3).collect()), key=str)
    assert got == want and sent[0] < sent[1] / 2


def test_bound_pairs_are_compared_once(spark):
    p = spark.createDataFrame([(i, str(i % 3), i % 2, 1.0) for i in range(12)] + [(12, "2", None, 1.0), (13, "2", 0, 0.1)], "id long, raw_name string, service_id long, match_confidence double")
    v = {"0": [1.0, 0.0], "1": [0.0, 1.0], "2": [0.0, 0.0]}
    names = spark.createDataFrame(list(v.items()), "q string, v array<double>")
    services = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "c long, v array<double>")
    out = M.suspect_bindings(p, names, services)
    assert sorted(r.id for r in out.collect()) == [2, 4, 5, 8, 10, 11]
    # the rows that come out meet pairs that are ready, not vectors
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in M.suspect_bindings(p, names, services, offset=4, window=3).collect()] in ([4, 5], [5, 4])


def test_pages_are_parsed_once(spark):
    row = "<tr><td>{}</td><td>{}</td></tr>"
    pages = ["<table>" + row.format("Приём", "100 тг") + row.format("нет", "нет") + "</table><p>Снимок - 70 тг</p>", "<p>Снимок - 70 тг</p><p>" + "о" * 170 + " - 5</p>", "", None]
    out = X.items_from_html(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert sorted((r.id, r.raw_name, r.price) for r in out.collect()) == [(0, "Приём", 100.0), (1, "Снимок", 70.0)]


def test_nodes_come_in_small_frames(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "<p class='a'>x</p>" * 5) for i in range(6)], "page_id long, html string").coalesce(1)
    want = sorted(map(tuple, X.html_nodes(pages).collect()))
    assert len(want) == 60
    seen = []
    monkeypatch.setattr(X, "NODES", 4)
    frame = type("Frame", (), {"mapInPandas": lambda self, run, kind: seen.append(run), "schema": pages.schema, "select": lambda self, *c: self})()
    X.html_nodes(frame)
    got = list(seen[0](iter([pages.select(F.col("page_id").alias("id"), "html").toPandas()])))
    assert max(map(len, got)) == 4 and sorted((r.id, r.kind, r.node_no, r.cells) for g in got for r in g.itertuples()) == want


def test_csv_cells_are_summed_where_they_lie(spark):
    texts = [(1, "Цена;Услуга\n100;ОАК, общий\n\n200;\"ОАМ; общий\""), (None, "Узи почек\t700\nУзи\t1,5"), (None, "ЭКГ\t80"), (3, "a,b\nc,d"), (4, None), (5, "МРТ,головы;900")]
    out = X.items_from_csv_text(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0, r.delim, r.raw_name, r.price) for r in out.collect())) == [(0, "\t", "Узи", 1.5), (0, "\t", "Узи почек", 700.0), (0, "\t", "ЭКГ", 80.0), (1, ";", "ОАК, общий", 100.0), (1, ";", "ОАМ; общий", 200.0), (5, ";", "МРТ,головы", 900.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Generate posexplode(cells") == 1


def test_adapters_go_with_their_pages(spark):
    card = '<div class="c n">{}</div><b class="p">от {} тг</b><i class="d">2 дн.</i>'
    pages = [(1, "https://a.x.com/1", card.format("ОАК", 100) + card.format("ОАМ", 200)), (2, "https://b.x.com/1", card.replace('"p"', '"q"').format("УЗИ", 300)), (3, "https://y.org", card.format("ЭКГ", 1)), (4, None, card.format("ЭКГ", 1))]
    rules = spark.createDataFrame([("x.com", "n", "q", "d"), ("a.x.com", "n", "p", "d")], "host string, name_class string, price_class string, days_class string")
    out = X.items_from_cards(spark.createDataFrame(pages, "page_id long, url string, html string"), rules)
    assert sorted((r.id, r.raw_name, r.price, r.duration_days) for r in out.collect()) == [(1, "ОАК", 100.0, 2), (1, "ОАМ", 200.0, 2), (2, "УЗИ", 300.0, 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInPandas")]  # no nodes meet adapters


def test_texts_stay_where_they_are_for_cities(spark):
    cities = spark.createDataFrame([("Астана",), ("Ош",)], "name string")
    t = spark.createDataFrame([(1, "Ош, ош"), (2, "из Астаны"), (3, "ш"), (4, "о ша")], "doc_id long, text string")
    out = X.detect_city(t, cities)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.city for r in out.collect()} == {1: "Ош", 2: "Астана"}
    assert not any("Aggregate" in x and "head" in x for x in plan.split("\n")) and "levenshtein" not in plan
