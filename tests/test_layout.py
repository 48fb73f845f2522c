import pytest
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.operators import document as D
from pagemill.operators import layout as L
from pagemill.operators import render as R
from pagemill.operators import tables as TB

LINE = "doc_id long, page_index int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, italic boolean, serif boolean, color int, kind string"


def lines(spark, rows, page=0):
    return spark.createDataFrame([(1, r[7] if len(r) > 7 else page, i, r[0], *map(float, r[1:5]), float(r[5] if len(r) > 5 else 10), False, False, True, 0, r[6] if len(r) > 6 else "paragraph") for i, r in enumerate(rows)], LINE)


def pages(spark, n=1):
    return spark.createDataFrame([(1, i, 600.0, 792.0) for i in range(n)], "doc_id long, page_index int, width double, height double")


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_geometry(spark):
    a, b = G.rect(0, 0, 10, 10), G.rect(5, 5, 20, 20)
    assert value(spark, G.overlap_ratio(a, b)) == 0.25 and value(spark, G.overlap_ratio(a, G.rect(20, 0, 30, 10))) == 0.0
    assert value(spark, G.overlap_ratio(G.rect(1, 1, 1, 5), a)) == 0.0
    assert value(spark, G.horizontal_share(G.rect(0, 0, 500, 10), G.rect(10, 20, 28, 30))) == 1.0
    assert value(spark, G.at_tail(G.rect(0, 0, 1, 730), F.lit(792.0))) and not value(spark, G.at_tail(G.rect(0, 0, 1, 72), F.lit(792.0)))
    assert value(spark, G.line_height(F.lit(0.0), F.lit(24.0), F.lit(3), F.lit(10.0))) == 1.2 and value(spark, G.line_height(F.lit(0.0), F.lit(0.0), F.lit(1), F.lit(10.0))) == 1.15
    assert value(spark, G.drawn_line_height(F.lit(1.2), F.lit(0.94))) == pytest.approx(1.164)


@pytest.mark.parametrize("values,least,small,want", [([50.0, 51.0, 52.9, 80.0], 2, True, 50.0), ([289.0, 289.5, 328.0], 2, False, 289.5), ([1.0, 9.0], 2, True, 1.0), ([1.0, 3.0, 5.0, 7.0], 2, True, 1.0), ([10.0, 14.0, 15.0], 2, True, 14.0)])
def test_repeated_edges(spark, values, least, small, want):
    assert value(spark, G.repeated_edge(F.array(*map(F.lit, values)), F.lit(least), small)) == want


def test_lines_from_spans(spark):
    rows = [(1, 0, 0, 0, 0, "ab", 9.04, 16, "X", 5), (1, 0, 0, 0, 1, "cdef", 10.06, 2, "Foo-Bold", 7), (1, 0, 0, 0, 2, "ghij", 8.0, 0, "X", 9), (1, 0, 0, 1, 0, "12", 8.0, 0, "X", 9)]
    df = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], "doc_id long, page_index int, block_no int, line_no int, span_no int, text string, size double, flags int, font string, color int, x0 double, y0 double, x1 double, y1 double")
    got = L.make_lines(df).collect()
    assert [(r["text"], r["size"], r["bold"], r["italic"], r["color"]) for r in got] == [("abcdefghij", 10.1, True, True, 7)]


def test_reading_order_of_two_columns(spark):
    rows = [("right 1", 310, 100, 540, 110), ("left 1", 50, 100, 290, 110), ("across", 50, 80, 550, 90), ("left 2", 50, 120, 290, 130), ("across 2", 50, 140, 550, 150), ("left 3", 50, 160, 290, 170)]
    r = L.reading_order(L.assign_columns(lines(spark, rows))).orderBy("read_no").collect()
    assert [x["text"] for x in r] == ["across", "left 1", "left 2", "right 1", "across 2", "left 3"]
    b = {x["column"]: (x["left"], x["right"]) for x in L.column_bounds(L.assign_columns(lines(spark, [("a", 50, 1, 302, 9), ("b", 50, 11, 302, 19), ("c", 294, 1, 540, 9), ("d", 294, 11, 540, 19)]))).collect()}
    assert b == {0: (50.0, 290.0), 1: (294.0, 540.0)}


def test_groups_and_blocks(spark):
    rows = [("Title", 50, 60, 200, 74, 14), ("first line of text that goes", 50, 100, 290, 110), ("on to inher-", 50, 112, 290, 122), ("ited ends here.", 50, 124, 150, 134), ("New one", 50, 136, 290, 146), ("• item", 50, 148, 290, 158), ("far", 50, 300, 290, 310), ("aside", 310, 600, 540, 610)]
    ls = L.assign_columns(lines(spark, rows))
    g = L.group_lines(L.reading_order(ls), L.column_bounds(ls))
    b = L.make_blocks(g, pages(spark), L.dominant_size(ls), L.line_boxes(ls)).orderBy("block_no").collect()
    assert [(x["kind"], x["text"]) for x in b] == [("heading", "Title"), ("paragraph", "first line of text that goes on to inherited ends here."), ("paragraph", "New one"), ("list_item", "• item"), ("paragraph", "far"), ("paragraph", "aside")]
    assert all(x["rect"]["y1"] <= y["rect"]["y0"] + 3 for x, y in zip(b, b[1:], strict=False)) and b[0]["block_id"] == "p0_x50_y60_n1"


def test_linking_across_columns_and_pages(spark):
    style = (10.0, False, False, True, 0)
    rows = [(1, 0, 1, "paragraph", "an open sen-", style, (50.0, 500.0, 290.0, 700.0)), (1, 0, 2, "caption", "Fig. 1", style, (50.0, 710.0, 290.0, 720.0)), (1, 0, 3, "paragraph", "tence goes on", style, (310.0, 60.0, 540.0, 700.0)), (1, 1, 1, "paragraph", "over the page.", style, (50.0, 60.0, 290.0, 100.0)), (1, 1, 2, "paragraph", "next one", style, (50.0, 110.0, 290.0, 150.0))]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, block_no long, kind string, text string, style struct<size:double,bold:boolean,italic:boolean,serif:boolean,color:int>, rect struct<x0:double,y0:double,x1:double,y1:double>").withColumns({"page_height": F.lit(792.0), "max_bottom": F.lit(700.0), "line_count": F.lit(1), "line_rects": F.array("rect"), "block_id": F.col("block_no").cast("string"), "align": F.lit(0), "line_height": F.lit(1.15)})
    m = L.merge_linked(L.link_blocks(df)).orderBy("page_index", "block_no").collect()
    assert [x["text"] for x in m] == ["an open sentence goes on over the page.", "Fig. 1", "next one"] and len(m[0]["areas"]) == 3


def test_kinds_and_furniture(spark):
    ls = lines(spark, [("in table", 100, 100, 200, 110), ("boxed", 300, 300, 340, 310), ("on figure", 400, 500, 450, 510), ("note", 50, 700, 100, 710), ("Table 2 x", 50, 200, 100, 210), ("plain", 50, 250, 100, 260)])
    d = spark.createDataFrame([(1, 0, 0, 295.0, 295.0, 345.0, 315.0, "f", 1), (1, 0, 1, 50.0, 690.0, 200.0, 691.0, "s", None), (1, 0, 2, -10.0, 0.0, 100.0, 50.0, "f", 1)], "doc_id long, page_index int, drawing_no int, x0 double, y0 double, x1 double, y1 double, type string, fill int")
    p = pages(spark)
    shape = lambda n, *r: p.select("doc_id", "page_index", F.lit(n).alias("shape"), F.lit(0).alias("ord"), G.rect(*r).alias("rect"))
    boxes, foot = L.closed_boxes(d, p, ls), L.footnote_rule(d, p)
    assert [x["shape"] for x in boxes.collect()] == ["p0_box0"] and foot.first()["footnote_top"] == 691.0
    got = {x["text"]: x["kind"] for x in L.classify(ls.drop("kind"), shape("t", 90, 90, 300, 200), boxes, shape("i", 390, 490, 500, 600), foot).collect()}
    assert got == {"in table": "table_cell", "boxed": "figure_label", "on figure": "figure_label", "note": "footnote", "Table 2 x": "table_title", "plain": "paragraph"}
    heads = [(f"Book {i}", 50, 20, 100, 30, 10, "paragraph", i) for i in range(3)] + [("Book 9", 50, 400, 100, 410, 10, "paragraph", 0)]
    m = L.mark_furniture(lines(spark, heads), pages(spark, 3)).collect()
    assert sorted((x["line_no"], x["kind"]) for x in m) == [(0, "page_furniture"), (1, "page_furniture"), (2, "page_furniture"), (3, "paragraph")]
    assert all(x["kind"] == "paragraph" for x in L.mark_furniture(lines(spark, heads[:2]), pages(spark, 2)).collect())
    label = L.boxed_labels(ls.withColumns({"kind": F.lit("figure_label"), "box_id": F.when(F.col("text") == "boxed", "p0_box0")}), boxes, p).first()
    assert label["align"] == L.ALIGN_CENTER and label["rect"]["x0"] == 296.5
    assert value(spark, L.widened(G.rect(0, 0, 10, 5), F.lit(13.0)))["x1"] == 13.0


def rects(*rs):
    return F.array(*[G.rect(*r) for r in rs])


def test_rectangles_merge_in_one_pass(spark):
    got = value(spark, TB.merged_rects(rects((0, 0, 10, 10), (100, 0, 110, 10), (5, 5, 105, 12), (300, 300, 310, 310))))
    assert [tuple(r) for r in got] == [(0, 0, 105, 12), (100, 0, 110, 10), (300, 300, 310, 310)]


def test_rule_clusters_and_regions(spark):
    three = rects((50, 100, 250, 100), (52, 150, 249, 150), (50, 200, 250, 200), (400, 10, 590, 10), (0, 5, 20, 5))
    assert [tuple(r) for r in value(spark, TB.rule_clusters(three, F.lit(600.0)))] == [(50, 100, 250, 200)]
    ls = lines(spark, [("a", 60, 110, 100, 120), ("b", 60, 160, 100, 170), ("c", 160, 110, 200, 120), ("d", 160, 122, 200, 132), ("e", 160, 160, 200, 170)])
    d = spark.createDataFrame([(1, 0, i, 50.0, y, 250.0, y, "s", None) for i, y in enumerate((100.0, 150.0, 200.0))] + [(1, 0, 9, -50.0, 0.0, 250.0, 90.0, "f", 1)], "doc_id long, page_index int, drawing_no int, x0 double, y0 double, x1 double, y1 double, type string, fill int")
    r = TB.regions(d, pages(spark), ls)
    row = r.first()
    assert row["shape"] == "p0_t0" and tuple(row["rect"]) == (50, 100, 250, 200) and row["row_rules"] == [100.0, 150.0, 200.0]
    c = TB.table_cells(ls.withColumn("table_id", F.lit("p0_t0")), r)
    got = c.orderBy("cell_no").collect()
    assert [(x["text"], tuple(x["rect"])) for x in got] == [("a", (60, 110, 156, 120)), ("c d", (160, 110, 200, 132)), ("b", (60, 160, 156, 170)), ("e", (160, 160, 200, 170))]
    b = TB.cell_blocks(c, pages(spark), L.line_boxes(ls)).collect()
    assert {x["block_id"] for x in b} == {f"p0_t0_c{i}" for i in range(4)} and all(x["max_bottom"] <= 200.0 for x in b)


def test_draw_plans(spark):
    assert R.pour("aa bb cc".split(), [(R.text_width("aa bb", 10) + 0.1, 12.0), (100.0, 12.0)], 10, 1.15) == (["aa bb", "cc"], 3)
    s, line, borrowed, chunks, over = R.fit("word " * 10, 10, 1.15, [(60.0, 12.0, 200.0)], True)
    assert s == 10 and borrowed and not over and chunks[0].split() == ["word"] * 10
    s, _, _, chunks, over = R.fit("word " * 100, 10, 1.15, [(60.0, 12.0, 12.0)], True)
    assert s == R.LEAST_SIZE and over and len(chunks[0].split()) == 100
    at = lambda t, x: (1, 0, t, x, 0.0, x + 1, 1.0)
    schema = "doc_id long, page_index int, text string, x0 double, y0 double, x1 double, y1 double"
    before = spark.createDataFrame([at("a", 0.0), at("b", 5.0), (1, 1, "c", 0.0, 0.0, 1.0, 1.0)], schema)
    after = spark.createDataFrame([at("b", 50.0), (1, 1, "c", 0.2, 0.0, 1.0, 1.0)], schema)
    assert {x["page_index"]: x["strategy"] for x in R.erase_strategy(before, after).collect()} == {0: "patch", 1: "redact"}
    px = spark.createDataFrame([(1, i, *c) for i, c in enumerate([(250, 250, 250), (255, 251, 249), (0, 0, 0)])], "box int, seq int, red int, green int, blue int")
    assert R.background(px, ["box"]).first()["red"] == 252 / 255
    fonts = spark.createDataFrame([(True, False, False, "Serif", "abc≥", False), (False, False, False, "Sans", "abc", False), (False, False, False, "Last", "abc→", True)], "serif boolean, bold boolean, italic boolean, font string, glyphs string, fallback boolean")
    blocks = spark.createDataFrame([(t, (10.0, False, False, False, 0)) for t in ("ab", "a≥", "a→", "a☃")], "text string, style struct<size:double,bold:boolean,italic:boolean,serif:boolean,color:int>")
    assert [x["font"] for x in R.font_for(blocks, fonts).collect()] == ["Sans", "Serif", "Last", "Sans"]


def test_cells_and_labels_cut_no_band(spark):
    rows = [("left 1", 50, 100, 290, 110), ("right 1", 310, 100, 540, 110), ("a wide cell", 50, 120, 550, 130, 10, "table_cell"), ("left 2", 50, 140, 290, 150), ("right 2", 310, 140, 540, 150)]
    r = L.reading_order(L.assign_columns(lines(spark, rows))).orderBy("read_no").collect()
    assert [x["text"] for x in r] == ["left 1", "left 2", "right 1", "right 2"]


def document(spark):
    text = [("Running head", 50, 20, 150, 30), ("An open sentence that goes on in the", 50, 700, 290, 710), ("cell a", 320, 110, 380, 120), ("cell b", 320, 126, 380, 136), ("in a box", 320, 305, 360, 315), ("on the figure", 320, 520, 400, 530)]
    rows = [(*r, 10, "paragraph", 0) for r in text] + [("Running head", 50, 20, 150, 30, 10, "paragraph", n) for n in (1, 2)]
    rows += [("next page, where it ends.", 50, 60, 290, 70, 10, "paragraph", 1), ("Another page.", 50, 100, 290, 110, 10, "paragraph", 2)]
    drawings = [(1, 0, 0, 310.0, 100.0, 560.0, 140.0, "f", 1), (1, 0, 1, 315.0, 300.0, 365.0, 320.0, "f", 1)]
    d = spark.createDataFrame(drawings, "doc_id long, page_index int, drawing_no int, x0 double, y0 double, x1 double, y1 double, type string, fill int")
    images = spark.createDataFrame([(1, 0, 310.0, 500.0, 560.0, 600.0)], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    return D.analyze(lines(spark, rows).drop("kind"), pages(spark, 3), d, images)


def test_a_document_from_lines_to_blocks(spark):
    got = document(spark).orderBy("seq").collect()
    assert [(x["kind"], x["text"]) for x in got] == [
        ("page_furniture", "Running head"), ("paragraph", "An open sentence that goes on in the next page, where it ends."), ("page_furniture", "Running head"), ("page_furniture", "Running head"), ("paragraph", "Another page."),
        ("table_cell", "cell a cell b"), ("figure_label", "on the figure"), ("figure_label", "in a box"),
    ]
    chain, cell, loose, boxed = got[1], got[5], got[6], got[7]
    assert [a["page_index"] for a in chain["areas"]] == [0, 1] and [r["page_index"] for r in chain["line_rects"]] == [0, 1] and chain["line_count"] == 2
    assert cell["block_id"] == "p0_t0_c0" and cell["areas"][0]["max_bottom"] <= 140.0 and cell["line_count"] == 2
    assert loose["areas"][0]["rect"]["x0"] == 320.0 and loose["areas"][0]["rect"]["x1"] > 400.0 and boxed["block_id"] == "p0_box1"
    assert sum(x["line_count"] for x in got) == 10 == sum(len(x["line_rects"]) for x in got)


def test_a_document_from_blocks_to_pages(spark):
    blocks = document(spark)
    t = spark.createDataFrame([(1, "p0_t0_c0", "Zelle a, Zelle b"), (1, "p0_box1", "")], "doc_id long, block_id string, translated_text string")
    got = {}
    for r in D.drawn(blocks, t).collect():
        got.setdefault((r["page_index"], r["block_id"]), []).append(r)
    assert got[0, "p0_t0_c0"][0]["text"] == "Zelle a, Zelle b" and got[0, "p0_box1"][0]["text"] == "in a box"
    chain = [r for k, rs in got.items() for r in rs if "sentence" in r["text"] or "ends" in r["text"]]
    assert {r["page_index"] for r in chain} <= {0, 1} and " ".join(r["text"] for r in sorted(chain, key=lambda r: r["page_index"])) == "An open sentence that goes on in the next page, where it ends."
    erased = R.erase_boxes(blocks).collect()
    assert len(erased) == 10 and all(r["rect"]["x1"] > r["rect"]["x0"] for r in erased)
    none = blocks.filter("false")
    assert D.drawn(none, t).count() == 0 and R.erase_boxes(none).count() == 0


def test_plans_pour_no_text_that_cannot_fit(spark, monkeypatch):
    import random

    r, poured = random.Random(4), []
    real = R.pour
    monkeypatch.setattr(R, "pour", lambda words, *a: poured.append(len(words)) or real(words, *a))
    tried = 0
    for _ in range(400):
        words = ["".join(r.choices("iWm aBc.", k=r.randint(1, 9))) for _ in range(r.randint(0, 60))]
        areas = [(r.uniform(-5, 250), h := r.uniform(0, 90), h + r.uniform(0, 60)) for _ in range(r.randint(1, 3))]
        text, size, line, borrows = " ".join(words), r.choice([5.0, 8.0, 10.0, 14.0]), 1.15, r.random() < 0.5
        got = R.fit(text, size, line, areas, borrows)
        for s, pitch, drawn, way in R.settings(size, line, borrows):
            tried += 1
            rects = [(w, more if way else h) for w, h, more in areas]
            chunks, n = real(text.split(), rects, s, pitch)
            if n == len(text.split()):
                assert got == (s, drawn, way, chunks, False)
                break
        else:
            assert got[4] and got[:3] == (s, drawn, way)
    assert len(poured) < tried / 2


def test_furniture_keys_are_reckoned_from_written_lines(spark, tmp_path):
    ls, ps = lines(spark, [("Title", 50, 60, 200, 74, 14), ("more text", 50, 100, 290, 110)]), pages(spark)
    none = spark.createDataFrame([], "doc_id long, page_index int, shape string, ord int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    drawings = spark.createDataFrame([], "doc_id long, page_index int, drawing_no int, x0 double, y0 double, x1 double, y1 double, type string, fill int")
    images = spark.createDataFrame([], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    placed, marked = D.classified(ls, ps, none, none, drawings, images)
    for df in (placed, marked):
        assert df.count() == 2 and "Join" not in df._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, tmp_path):
    texts = ["• One item.\n" + "\n".join(f"line {i} of a text" for i in range(45)) + "\nTable 1 x", "Book 1\nits end.\nGoes on", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_kinds_need_no_text_once_it_is_read(spark):
    # furniture, a table's title, a figure, and text
    rows = [(f"Book {i}", 50, 20, 100, 30, 10, "paragraph", i) for i in range(3)] + [("Table 1 x", 50, 400, 100, 410, 10, "paragraph", 0), ("on figure", 50, 500, 100, 510, 10, "paragraph", 0), ("text", 50, 600, 100, 610, 10, "paragraph", 0)]
    ls, p = lines(spark, rows).drop("kind"), pages(spark, 3)
    none = p.filter("false").select(*L.PAGE, F.lit("t").alias("shape"), F.lit(0).alias("ord"), G.rect(0, 0, 1, 1).alias("rect"))
    figure = p.select(*L.PAGE, F.lit("f").alias("shape"), F.lit(0).alias("ord"), G.rect(0, 490, 600, 520).alias("rect"))
    foot = p.filter("false").select(*L.PAGE, F.lit(1.0).alias("footnote_top"))
    marked = lambda x: {r["line_no"]: r["kind"] for r in L.mark_furniture(L.classify(x, none, none, figure, foot), p).collect()}
    read = L.text_kinds(ls, p)
    assert marked(read.drop("text")) == marked(ls) == marked(L.text_kinds(read, p)) == {0: "page_furniture", 1: "page_furniture", 2: "page_furniture", 3: "table_title", 4: "figure_label", 5: "paragraph"}
    assert plan(L.classify(read.drop("text"), none, figure, figure, foot)).count("Generate explode") == 2  # lines meet the shapes of all sorts at once


def test_the_first_shape_holds_a_line_whatever_its_share(spark):
    ls, p = lines(spark, [("a", 0, 0, 100, 10)]).drop("kind"), pages(spark)
    shape = lambda *rs: spark.createDataFrame([(1, 0, n, o, x) for n, o, x in rs], "doc_id long, page_index int, shape string, ord int, w double").select(*L.PAGE, "shape", "ord", G.rect(0, 0, F.col("w"), 10).alias("rect"))
    foot = p.filter("false").select(*L.PAGE, F.lit(1.0).alias("footnote_top"))
    got = lambda t, b, i: tuple(L.classify(ls, shape(*t), shape(*b), shape(*i), foot).first()[c] for c in ("kind", "table_id", "box_id"))
    assert got([("t1", 1, 90.0), ("t0", 0, 59.0), ("t2", 2, 99.0)], [("b", 0, 80.0)], [("f", 0, 80.0)]) == ("table_cell", "t1", None)
    assert got([("t", 0, 59.0)], [("b", 0, 74.0), ("c", 1, 76.0)], [("f", 0, 90.0)]) == ("figure_label", None, "c")
    assert got([("t", 0, 59.0)], [("b", 0, 74.0)], [("f", 0, 56.0)]) == ("figure_label", None, None)
    assert got([("t", 0, 59.0)], [("b", 0, 74.0)], [("f", 0, 54.0)]) == ("paragraph", None, None)


def test_pages_of_a_trial_are_met_without_a_join(spark):
    # blank pages, texts that stand where they stood, one that moved, a page that only the trial has
    at = lambda page, t, x: (1, page, t, x, 0.0, x + 1, 1.0)
    schema = "doc_id long, page_index int, text string, x0 double, y0 double, x1 double, y1 double"
    before = spark.createDataFrame([at(0, " ", 0.0), at(1, "a", 0.0), at(1, "a", 0.0), at(1, "b", 5.0), at(2, "a", 0.0), at(3, None, 0.0)], schema)
    after = spark.createDataFrame([at(0, " ", 9.0), at(1, "b", 5.4), at(2, "b", 0.0), at(3, None, 7.0), at(4, "a", 0.0)], schema)
    got = R.erase_strategy(before, after)
    assert {x["page_index"]: x["strategy"] for x in got.collect()} == {0: "redact", 1: "redact", 2: "patch", 3: "redact"}
    assert "Join" not in plan(got)


def test_columns_of_a_table_reach_to_the_next_without_a_join(spark):
    # texts stay where they are unless they are asked for
    ls = lines(spark, [("a", 60, 110, 200, 120), ("b", 70, 130, 100, 140), ("c", 160, 110, 250, 120), ("d", 300, 110, 310, 120)]).withColumn("table_id", F.when(F.col("text") != "b", "t").otherwise("u"))
    got = TB.table_columns(ls.unionByName(ls.withColumn("table_id", F.lit(None).cast("string"))))
    assert sorted((x["text"], x["col_no"], x["col_x0"], x["col_x1"]) for x in got.collect()) == [("a", 0, 60.0, 200.0), ("b", 0, 70.0, 100.0), ("c", 1, 160.0, 296.0), ("d", 2, 300.0, 310.0)]
    assert "Join" not in plan(got)
    region = pages(spark).select(*L.PAGE, F.lit("t").alias("shape"), G.rect(0, 0, 600, 700).alias("rect"), F.array(F.lit(1.0)).alias("row_rules"))
    cells = TB.table_cells(ls, region)
    assert plan(cells).count("collect_list") == 2 and plan(cells.select("cell_no", "line_count")).count("collect_list") == 1


def test_queries_read_the_documents_once(spark, tmp_path):
    from pagemill.plans import account_queries as AQ
    from pagemill.plans import layout_queries as LQ

    d = documents(spark, tmp_path)
    for name, most in ((AQ.closed_boxes, 0), (LQ.classified_lines, 0), (LQ.paragraph_groups, 0), (LQ.span_lines, 1)):
        assert name(spark, d)._jdf.queryExecution().optimizedPlan().toString().count("split(text") == most, name
    assert LQ.span_lines(spark, d).count() == 50 and LQ.classified_lines(spark, d).count() == 50
    grouped = {(r["doc_id"], r["line_no"]): r["group_no"] for r in LQ.paragraph_groups(spark, d).collect()}
    assert len(grouped) == 50 and grouped[1, 0] == 1


def test_groups_need_no_text_once_its_signs_are_read(spark):
    # F24
    rows = [("one that ends.", 50, 100, 150, 110), ("New one", 50, 112, 290, 122), ("• item", 50, 124, 290, 134), ("goes on", 50, 136, 290, 146)]
    groups = lambda x: {r["line_no"]: r["group_no"] for r in L.group_lines(L.reading_order(L.assign_columns(x)), L.column_bounds(L.assign_columns(x))).collect()}
    assert groups(L.signs(lines(spark, rows)).drop("text")) == groups(lines(spark, rows)) == {0: 1, 1: 2, 2: 3, 3: 3}


def test_no_page_goes_through_the_driver(spark, tmp_path, monkeypatch):
    # F1, F2, F3, which share it: pages are so well compressed that millions of them looked small enough to be sent to every task
    from pagemill.plans import layout_queries as LQ

    plans, real = [], D.kept
    seen = lambda df, name: plans.append(df) or real(df, name)
    for module in (D, LQ):
        monkeypatch.setattr(module, "kept", seen)
    out = LQ.document_blocks(spark, documents(spark, tmp_path))
    assert len(plans) > 5 and out.count()
    assert not [p for p in (*plans, out) if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]


def test_texts_stay_behind_where_lines_are_counted_or_erased(spark, monkeypatch):
    # what is written on the way has no text, and nothing is joined for it unless it is asked for
    written, real = {}, D.kept
    monkeypatch.setattr(D, "kept", lambda df, name: written.setdefault(name, df.columns) and real(df, name))
    blocks = document(spark)
    assert len(written) > 5 and [n for n, columns in written.items() if "text" in columns] == ["lines"]
    for asked in (blocks.groupBy("doc_id", "kind").agg(F.sum("line_count")), R.erase_boxes(blocks)):
        assert "Join" not in plan(asked)
    assert "Join" in plan(blocks.select("doc_id", "seq", "text"))
