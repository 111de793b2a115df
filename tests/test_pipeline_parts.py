"""Chunks, office files, configuration, plugins, the query surface, answers, serving and streams."""

import io
import json
import threading
import urllib.error
import urllib.request
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.sections import ChunkOptions, chunk_documents, chunk_sections, lines, paragraphs
from quillgraph.plans import answers, engine, guard, ingest, plugins, server
from quillgraph.schemas import SECTIONS
from quillgraph.sources import config, files, office
from quillgraph.streaming import ingest as streaming


def section(content, heading=None, level=0, page=None):
    return {"heading": heading, "heading_level": level, "content": content, "page_number": page}


def test_chunks():
    with pytest.raises(ValueError):
        ChunkOptions(target=0)
    with pytest.raises(ValueError):
        ChunkOptions(target=10, overlap=10)
    rows = [section("", "One", 1), section("alpha.", None), section("", "Sub", 2), section("beta.", None, 0, 3), section("", "Two", 1), section("gamma.")]
    out = list(chunk_sections(rows, ChunkOptions(100, 10)))
    assert [(c["content"], c["heading_path"], c["section_title"]) for c in out] == [("alpha.", ["One"], "One"), ("beta.", ["One", "Sub"], "Sub"), ("gamma.", ["Two"], "Two")]
    assert out[1]["pages"] == [3] and [c["seq"] for c in out] == [0, 1, 2] and all(c["first_in_section"] and c["last_in_section"] for c in out)
    long = "\n\n".join(f"Paragraph {i} has some words in it." for i in range(40))
    out = list(chunk_sections([section(long)], ChunkOptions(100, 10)))
    assert len(out) > 3 and all(c["tokens"] <= 130 for c in out) and out[1]["overlap"]
    out = list(chunk_sections([section(" ".join(f"Sentence number {i} goes here." for i in range(60)))], ChunkOptions(50, 5)))
    assert len(out) > 3 and all(0 < c["tokens"] < 80 for c in out)
    table = "a\tb\n1\t2"
    assert [c["kind"] for c in chunk_sections([section("text."), section(table)], ChunkOptions(100, 10))] == ["text", "table"]
    merged = list(chunk_sections([section("tiny."), section("next one.")], ChunkOptions(100, 10, minimum=20)))
    assert [c["content"] for c in merged] == ["tiny.\n\nnext one."]


def test_chunks_name_the_pages_they_touch(caplog):
    rows = [section("tiny.", page=3), section("", page=4), section("next one.", page=5)]
    assert [c["pages"] for c in chunk_sections(rows, ChunkOptions(100, 10, minimum=20))] == [[3, 5]]
    # The tail fills the budget with nothing of the next section, so it stays on its own page.
    assert [(c["content"], c["pages"]) for c in chunk_sections([section("tiny.", page=1), section("word " * 7 + "end", page=2)], ChunkOptions(10, 0, minimum=5))] == [("tiny.", [1]), ("word " * 7 + "end", [2])]
    assert [c["pages"] for c in chunk_sections([section("one.", page=1), section("two.", page=2), section("three.")], ChunkOptions(100, 10, minimum=20))] == [[1, 2]]
    assert not caplog.records
    table = "\n".join("a\tb" for _ in range(40))
    assert [c["kind"] for c in chunk_sections([section(table)], ChunkOptions(20, 5, maximum=30))] == ["table"] and "maximum" in caplog.text


def test_chunk_ids_repeat(spark):
    df = spark.createDataFrame([("d", 0, "H", 1, "", None), ("d", 1, None, 0, "text here", 1), ("e", 0, None, 0, "more", None)], SECTIONS)
    one = lambda: sorted((r["doc_id"], r["seq"], r["chunk_id"]) for r in chunk_documents(df).collect())
    assert one() == one() and len(one()) == 2


def test_paragraphs_of_lines(spark):
    df = spark.createDataFrame([("d", "Title\n\nfirst line\nsecond  line\n\nthird.")], "doc_id string, text string")
    assert [r["paragraph"] for r in paragraphs(lines(df)).orderBy("first_seq").collect()] == ["first line second line", "third."]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def a_docx():
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    li = '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'
    tbl = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    return packed(**{"word__document.xml": f"<w:document {W}><w:body>{p('Head', 'Heading2')}{p('Acme Corp  met Jane Wilson')}{li}{li}{tbl}</w:body></w:document>"})


def a_pptx():
    sp = lambda text, ph="": f'<p:sp><p:nvPr>{ph}</p:nvPr><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sp>'
    ns = 'xmlns:p="p" xmlns:a="a"'
    return packed(**{"ppt__slides__slide10.xml": f"<p:sld {ns}>{sp('Last')}{sp('body')}</p:sld>", "ppt__slides__slide2.xml": f"<p:sld {ns}>{sp('text')}{sp('Title', '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>')}</p:sld>", "ppt__notesSlides__notesSlide2.xml": f"<p:notes {ns}>{sp('say this')}</p:notes>", "ppt__media__i.png": "x"})


def a_xlsx():
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    rows = f'<row>{cell("A1", "name")}{cell("B1", "n")}</row><row>{cell("A2", "x, y")}<c r="B2"><v>5</v></c></row><row>{cell("A3", "z")}<c r="B3"><v>2.5</v></c></row>'
    return packed(**{"xl__workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Q3" r:id="1"/><sheet name="Note" r:id="2"/></sheets></workbook>', "xl___rels__workbook.xml.rels": '<R><Relationship Id="1" Target="worksheets/sheet1.xml"/><Relationship Id="2" Target="worksheets/sheet2.xml"/></R>', "xl__worksheets__sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>", "xl__worksheets__sheet2.xml": f"<worksheet><sheetData><row>{cell('A1', 'only')}</row></sheetData></worksheet>"})


def test_office_readers():
    d = office.docx(a_docx())
    assert [(s["heading"], s["heading_level"], s["content"]) for s in d["sections"]] == [("Head", 2, "Head"), (None, 0, "Acme Corp met Jane Wilson"), (None, 0, "- item\n- item"), (None, 0, "a\tb")]
    p = office.pptx(a_pptx())
    assert [(s["heading"], s["content"], s["page_number"]) for s in p["sections"]] == [("Title", "Title", 2), (None, "text" + office.NOTES + "say this", 2), ("Last", "Last", 10), (None, "body", 10)] and p["images"] == ["ppt/media/i.png"]
    x = office.xlsx(a_xlsx())
    assert [s["content"] for s in x["sections"]] == ["Q3", 'This worksheet contains 2 rows with columns: name (string), n (number).\n\nSample rows (first 2):\nname,n\n"x, y",5\nz,2.5', "Note", "only"] and len(x["tables"]) == 2
    assert office.column_type([datetime(2020, 1, 1), "x"]) == "date" and office.column_type([]) == "empty"
    with pytest.raises(office.ParserError):
        office.docx(b"no zip")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "a").mkdir()
    (root / ".git").mkdir()
    (root / "a" / "one.docx").write_bytes(a_docx())
    (root / "two.PPTX").write_bytes(a_pptx())
    (root / "bad.xlsx").write_bytes(b"broken")
    (root / ".git" / "x.docx").write_bytes(a_docx())
    (root / "skip.txt").write_text("x")
    return root


def test_model_calls(spark):
    with pytest.raises(Exception, match="dimensions"):
        ingest.embed(spark.createDataFrame([("a", "b")], "chunk_id string, text string"), lambda t: [[0.0]], 2, "chunk_id", "text").collect()
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise ingest.Transient
        return "ok"

    assert ingest.with_retries(call, base_s=0.001) == "ok" and len(tries) == 3


def test_command_line_writes_a_graph(spark, folder, tmp_path):
    from quillgraph.__main__ import main

    (tmp_path / "p.toml").write_text('[models."stub"]\ninput_per_million = 1.0\n')
    at = main(["ingest", str(folder), str(tmp_path / "out"), "--prices", str(tmp_path / "p.toml")])
    assert spark.read.parquet(f"{at}/entities").count() == 2 and spark.read.parquet(f"{at}/mentions").count() == 2
    assert spark.read.parquet(f"{at}/calls").where("cost_usd > 0").count() > 0


class Watch:
    """Tells which hooks ran on which documents."""

    name = "watch"

    def __init__(self):
        self.seen = {}

    def _take(self, hook, rows):
        self.seen[hook] = sorted(r["relative_path"] for r in rows.collect())

    def files_discovered(self, rows):
        self._take("found", rows)

    def entities_extracted(self, rows):
        self.seen["extracted"] = rows[0].count()

    def documents_completed(self, rows):
        self._take("done", rows)

    def documents_removed(self, rows):
        self._take("gone", rows)


def paragraph_docx(text):
    return packed(**{"word__document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>"})


def test_two_runs_and_a_question(spark, folder, tmp_path):
    """The second run keeps what the first found, pays for nothing twice, follows changed files and answers over both."""
    root, out = tmp_path / "in", str(tmp_path / "graph")
    root.mkdir()
    (root / "one.docx").write_bytes(paragraph_docx("Acme Steel Works met Jane Wilson"))
    (root / "copy.docx").write_bytes(paragraph_docx("Acme Steel Works met Jane Wilson"))
    (root / "two.docx").write_bytes(paragraph_docx("then Blue River talked"))
    (root / "bad.docx").write_bytes(b"broken")
    watch, cost = Watch(), plugins.CostReporter()
    hooks = plugins.PluginManager().register(watch).register(plugins.ConfidenceFilter()).register(plugins.DomainTagger([("*", "top")])).register(cost)
    prices = spark.createDataFrame([("stub", 1.0, 1.0)], engine.PRICES)
    at = engine.run(spark, str(root), out, plugins=hooks, prices=prices)
    t = lambda name: spark.read.parquet(f"{at}/{name}")
    assert watch.seen["done"] == ["copy.docx", "two.docx"] and "gone" not in watch.seen and watch.seen["extracted"] == 3
    assert {r["properties"]["domain"] for r in t("documents").collect()} == {"top"} and t("errors").count() == 1
    assert t("statistics").first().asDict() == {"chunks": 2, "entities": 3, "relationships": 1, "entities_written": 3, "relationships_written": 1}
    assert t("entity_vectors").count() == 3 and t("vectors").count() == t("paragraphs").count() == 2
    assert cost.report["totals"][("total", "")] > 0

    (root / "two.docx").write_bytes(paragraph_docx("now Acme Steel Work talked to Green Hill"))
    asked = tmp_path / "asked"

    def counting(text, path):
        with open(asked, "a") as f:
            f.write(text + "\n")
        return ingest.stub_extractor(text, path)

    at = engine.run(spark, str(root), out, plugins=hooks, models=engine.Models(extractor=counting))
    assert asked.read_text().splitlines() == ["now Acme Steel Work talked to Green Hill"]
    assert watch.seen["done"] == watch.seen["gone"] == ["two.docx"] and t("documents").count() == 2
    # The judge merges two names that share a word in two, if their vectors are near; nothing of the old file is left.
    names = {r["name"]: r["aliases"] for r in t("entities").collect()}
    assert "Blue River" not in names and {"Jane Wilson", "Green Hill"} <= set(names)
    ids = {r["id"] for r in t("entities").collect()}
    assert {r["entity_id"] for r in t("mentions").collect()} == ids and t("calls").count() == 6
    with pytest.raises(ValueError, match="vectors"):
        engine.run(spark, str(root), out, models=engine.Models(dims=8))
    routes = server.retrieval_routes(engine.graph_tables(spark, at), lambda q: ingest.stub_embedder()([q])[0], config.Config())
    found = routes["/api/v1/rag"]({"question": "who met Jane Wilson"})
    assert found["sources"] and found["answer"]
    hill = [r["id"] for r in t("paragraphs").where("content like '%Green Hill'").collect()]
    assert len(hill) == 1 and hill[0] in {x["id"] for x in routes["/api/v1/hybrid-search"]({"question": "Green Hill"})["paragraphs"]}


def test_budget_stops_the_run_and_the_next_goes_on(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "graph")
    root.mkdir()
    for i in range(6):
        (root / f"{i}.docx").write_bytes(paragraph_docx(f"number {i} of Acme Corp"))
    prices = spark.createDataFrame([("big", 1e6, 0.0)], engine.PRICES)
    models = engine.Models(extractor=lambda t, p: ingest.stub_extractor(t, p) | {"model": "big", "input_tokens": 1, "output_tokens": 0})
    at = engine.run(spark, str(root), out, config.Config(cost=config.Cost(budget_per_run=1.0)), models=models, prices=prices)
    some = spark.read.parquet(f"{at}/documents").count()
    assert 1 <= some < 6 and spark.read.parquet(f"{at}/extractions").count() == some
    at = engine.run(spark, str(root), out, models=models, prices=prices)
    assert spark.read.parquet(f"{at}/documents").count() == 6 == spark.read.parquet(f"{at}/extractions").count()
    assert spark.read.parquet(f"{at}/entities").first()["mention_count"] == 6


def test_similar_entities_merge_once(spark):
    """Near names merge by the judge, the log keeps rejected pairs, canonicals get a new vector, and a dry run only logs."""
    texts = []

    def embedder(rows):
        texts.extend(rows)
        return [[1.0, 0.001 * (i % 3)] for i in range(len(rows))]

    docs = spark.createDataFrame([("d", 5)], "document_id string, processed_at long")
    ents = spark.createDataFrame([("e1", "Blue River", "Org", "blue river"), ("e2", "Blue River Bank", "Org", "blue river bank"), ("e3", "Green Hill", "Org", "green hill")], "id string, name string, type string, normalized_name string").withColumn("document_id", F.lit("d")).withColumn("aliases", F.array().cast("array<string>"))
    rows = {"documents": docs, "entities": ents, "mention_counts": spark.createDataFrame([("e1", 3), ("e2", 1), ("e3", 1)], "entity_id string, mention_count long"),
        "mentions": spark.createDataFrame([(e, f"c{e}", f"p{e}", f"text of {e}") for e in ("e1", "e2", "e3")], "entity_id string, chunk_id string, paragraph_id string, context string"),
        "relationships": spark.createDataFrame([("e2", "KNOWS", "e3", ["seen"], ["d"], 0.9)], "source_id string, type string, target_id string, evidence array<string>, source_documents array<string>, confidence double")}
    models = engine.Models(embedder=embedder, dims=2, embedding_model="m")
    out = engine.resolve(rows, models)
    assert {r["name"]: r["aliases"] for r in out["entities"].collect()} == {"Blue River": ["Blue River Bank"], "Green Hill": []}
    assert {(r["decision"], r["applied"]) for r in out["merges"].collect()} == {("same", True), ("different", False)} and out["merges"].count() == 3
    assert [(r["source_id"], r["source_documents"]) for r in out["relationships"].collect()] == [("e1", ["d"])]
    assert sorted(r["entity_id"] for r in out["mentions"].collect()) == ["e1", "e1", "e3"]
    again = engine.resolve(rows, models, vectors=out["entity_vectors"], merges=out["merges"])
    assert again["entities"].count() == 2 and again["merges"].count() == 3
    dry = engine.resolve(rows, models, dry_run=True)
    assert dry["entities"].count() == 3 and dry["merges"].where("applied").count() == 0 and dry["merges"].count() == 3


def test_stream_takes_each_file_once(spark, folder, tmp_path):
    log, check, seen = str(tmp_path / "log"), str(tmp_path / "check"), []

    def process(df, n):
        seen.extend(r["path"] for r in df.select("path").collect())
        bad = F.col("path").contains("bad")
        return df.select("path", F.sha2("path", 256).alias("document_id"), F.lit(0.5).alias("cost_usd"), F.when(bad, "broken").alias("error"))

    def drain():
        streaming.ingest(streaming.file_stream(spark, str(folder), per_trigger=2, types={"docx": "docx", "xlsx": "xlsx"}), log, check, process).awaitTermination(120)

    drain()
    first = len(seen)
    drain()
    assert len(seen) == first == len(set(seen)) or first == 2
    rows = {r["file_path"].rsplit("/", 1)[-1]: r["status"] for r in streaming.read_log(spark, log).collect()}
    assert rows["bad.xlsx"] == "failed" and rows["one.docx"] == "completed"
    assert streaming.dead_letters(spark, log).count() == 1
    assert streaming.read_log(spark, str(tmp_path / "none")).count() == 0


def test_windows_of_a_table(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "x", 1.0) for m in (0, 30, 59)] + [(datetime(2024, 1, 1, 1, 0), "x", 2.0)], "at timestamp, call_type string, cost_usd double")
    assert sorted(r["cost"] for r in streaming.windowed_costs(df).collect()) == [2.0, 3.0]


def test_config_layers(spark, tmp_path):
    (tmp_path / "default.toml").write_text("[api]\nmax_rows = 5\n[rag]\nmax_hops = 3\n")
    (tmp_path / "test.toml").write_text("[api]\nmax_rows = 6\n")
    c = config.load_config(str(tmp_path), env={"QUILL_API__TIMEOUT_MS": "10", "QUILL_ENV": "test"})
    assert (c.api.max_rows, c.api.timeout_ms, c.rag.max_hops, c.hybrid.paragraph_top_k) == (6, 10, 3, 15)
    (tmp_path / "bad.toml").write_text("[api]\nmax_rows = 'x'\n")
    for env in ({}, {"QUILL_API__NOPE": "1"}):
        with pytest.raises(config.ConfigError):
            config.load_config(path=str(tmp_path / "bad.toml"), env=env)
    (tmp_path / "p.toml").write_text('[models."m"]\ninput_per_million = 1.0\n')
    assert config.load_pricing(spark, str(tmp_path / "p.toml")).first()["input_per_million"] == 1.0
    (tmp_path / "o.json").write_text(json.dumps({"entityTypes": [{"name": "A"}], "relationshipTypes": [{"name": "b"}]}))
    assert [t.first()["name"] for t in config.load_ontology(spark, str(tmp_path / "o.json"))] == ["A", "b"]


def test_plugins(spark):
    class Skip:
        name = "skip"

        def files_discovered(self, rows):
            return rows.where("path <> 'b'")

    class Fail:
        name = "fail"

        def files_discovered(self, rows):
            raise RuntimeError("no")

    df = spark.createDataFrame([("a", "finance/a"), ("b", "b")], "path string, relative_path string")
    m = plugins.PluginManager().register(Fail()).register(Skip())
    assert [r["path"] for r in m.run("files_discovered", df).collect()] == ["a"]
    with pytest.raises(plugins.HookFailed):
        plugins.PluginManager().register(Fail(), halt=True).run("files_discovered", df)
    tag = plugins.build([{"name": "domain-tagger", "options": {"rules": [("finance/**", "fin")]}}])
    assert [r["properties"] for r in tag.run("documents_parsed", df).orderBy("path").collect()] == [{"domain": "fin"}, {}]
    calls = spark.createDataFrame([("extraction", "m", "d", 1.0)], "call_type string, model string, document_id string, cost_usd double")
    cost = plugins.CostReporter()
    plugins.PluginManager().register(cost).run("run_completed", calls)
    assert cost.report["totals"][("total", "")] == 1.0 and cost.report["averages"]["avg_resolution"] == 0


@pytest.mark.parametrize("sql", ["SELECT 'DROP TABLE x; --'", "select 1 -- delete", "/* create */ WITH a AS (SELECT 1 AS set_) SELECT * FROM a", "(select 1)", "SELECT 'DROPLET'", "SELECT replace('a', 'a', 'b')", "SELECT max(id) FROM range(3) WHERE id IN (SELECT col FROM explode(array(1, 2)))", "SELECT count(*) OVER w AS n FROM VALUES (1) AS t(a) WINDOW w AS (PARTITION BY a)"])
def test_guard_lets_queries_pass(spark, sql):
    guard.check_read_only(spark, sql)
    assert guard.run_query(spark, sql)["row_count"] == 1


@pytest.mark.parametrize("sql", ["", "DROP TABLE x", "select 1; drop table x", "INSERT INTO t VALUES (1)", "/* x */ DELETE FROM t", "SELECT reflect('java.lang.System', 'exit', 0)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "x" * 10_001,
    "FROM v INSERT OVERWRITE DIRECTORY '/tmp/quillgraph-never' USING json SELECT id", "FROM v INSERT INTO a SELECT id INSERT INTO b SELECT id", "SELECT `reflect`('java.lang.System','getProperty','java.version')", "SELECT /**/ java_method('java.lang.System','exit', 1)",
    "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM v WHERE id IN (SELECT value FROM text.`/etc/hostname`)", "SELECT (SELECT max(`try_reflect`('java.lang.System','getProperty','java.version')))", "SELECT * FROM other_table", "SELECT * FROM spark_catalog.default.v", "SELECT * FROM v ORDER BY `reflect`('a', 'b')",
    "SELECT TRANSFORM(id) USING 'cat' AS x FROM v", "SET x = 1", "SHOW TABLES", "CACHE TABLE v", "EXPLAIN SELECT 1", "SELECT * FROM v LATERAL VIEW reflect('a', 'b') t AS c", "WITH a AS (SELECT * FROM json.`/etc`) SELECT * FROM a"])
def test_guard_stops_the_rest(spark, sql):
    spark.range(2).createOrReplaceTempView("v")
    with pytest.raises(guard.QueryRejected):
        guard.run_query(spark, sql)


def test_query_results(spark):
    out = guard.run_query(spark, "SELECT 9007199254740993 AS big, 5L AS small, cast(null as string) AS n, timestamp '2024-01-01 00:00:00' AS t, 'a\"b' AS s")
    assert json.loads(out["rows"][0]) == {"big": "9007199254740993", "small": 5, "n": None, "t": "2024-01-01T00:00:00.000Z", "s": 'a"b'} and len(out["query_hash"]) == 12
    with pytest.raises(guard.ResultTooLarge):
        guard.run_query(spark, "SELECT id FROM range(11)", max_rows=10)


def test_server(spark):
    p = spark.createDataFrame([(f"p{i}", "d", "f.txt", 1, "H", i, f"text {i}", [1.0, i / 10]) for i in range(4)], "id string, document_id string, file_name string, page_number int, section_heading string, sequence_index int, content string, embedding array<double>")
    e = spark.createDataFrame([("e1", "Acme", "Org", [1.0, 0.0])], "id string, name string, type string, embedding array<double>")
    m = spark.createDataFrame([("e1", "p0")], "entity_id string, paragraph_id string")
    r = spark.createDataFrame([], "edge_id string, kind string, src string, dst string, evidence array<string>, confidence double")
    routes = server.retrieval_routes(answers.GraphTables(p, e, m, r), lambda q: [1.0, 0.0], config.Config(hybrid=config.Retrieval(enabled=False)))
    s = server.create_server(spark, config.Api(token="longenough"), routes)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def ask(path, body=None, token="longenough"):
        r = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(r, timeout=60) as x:
                return x.status, json.load(x)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert ask("/health")[0] == 200 and ask("/api/v1/health")[0] == 200
    status, body = ask("/api/v1/rag", {"question": "Who?", "paragraphTopK": 2})
    assert status == 200 and body["answer"] and body["citations"] == [1] and body["sources"]
    assert ask("/api/v1/hybrid-search", {"question": "Who?"})[0] == 503 and ask("/api/v1/rag", {"question": ""})[0] == 400 and ask("/api/v1/rag", {"question": "Who?", "hops": 9})[0] == 400
    found = server.retrieval_routes(answers.GraphTables(p, e, m, r), lambda q: [1.0, 0.0], config.Config())["/api/v1/hybrid-search"]({"question": "Who?", "paragraphTopK": 1, "entityTopK": 1})
    assert [(x["id"], x["origin"]) for x in found["paragraphs"]] == [("p0", "vector"), ("p1", "expansion")] and found["entities"][0]["id"] == "e1" and found["relationships"] == []
    assert ask("/api/v1/query", {"query": "SELECT 1 AS x"}) == (200, {"rows": [{"x": 1}], "rowCount": 1, "queryHash": guard.run_query(spark, "SELECT 1 AS x")["query_hash"]})
    assert [ask("/api/v1/query", {"query": "SELECT 1"}, "wrong")[0], ask("/api/v1/query", {"query": "DROP TABLE x"})[0], ask("/api/v1/query", {"query": "SELECT id FROM range(9)", "maxRows": 3})[0], ask("/nope", {})[0]] == [401, 400, 413, 404]
    s.shutdown()
    assert server.error_body(RuntimeError("secret")) == (500, {"error": {"code": "internal_error", "message": "Internal server error"}})
    with pytest.raises(config.ConfigError):
        server.create_server(spark, config.Api(token="short"))


def test_questions(spark):
    p = spark.createDataFrame([(f"p{i}", "d", "f.txt", 1, "H", i, f"text {i}", [1.0, i / 10]) for i in range(8)], "id string, document_id string, file_name string, page_number int, section_heading string, sequence_index int, content string, embedding array<double>")
    e = spark.createDataFrame([("e1", "Acme", "Org", [1.0, 0.0]), ("e2", "Jane", "Person", [0.0, 1.0])], "id string, name string, type string, embedding array<double>")
    m = spark.createDataFrame([("e1", "p0"), ("e2", "p7")], "entity_id string, paragraph_id string")
    r = spark.createDataFrame([("x", "KNOWS", "e1", "e2", ["seen"], 0.8)], "edge_id string, kind string, src string, dst string, evidence array<string>, confidence double")
    t = answers.GraphTables(p, e, m, r)
    req = answers.Request(paragraph_top_k=2, entity_top_k=1, hops=1)
    found = answers.hybrid_search(t, [1.0, 0.0], req)
    rows = {x["id"]: (round(x["score"], 3), x["origin"]) for x in found["paragraphs"].collect()}
    assert rows["p0"] == (1.0, "vector") and rows["p2"] == (0.4, "expansion") and rows["p7"] == (0.4, "expansion") and "p5" not in rows
    assert found["relationships"].count() == 1
    out = answers.answer_question(t, "Who?", lambda q: [1.0, 0.0], r=req)
    assert out["sources"] == [1, 2, 3, 4] and out["orphan_citations"] == [] and "(Acme) --[KNOWS]--> (Jane) [evidence: seen]" in out["context"]
    wrong = answers.answer_question(t, "Who?", lambda q: [1.0, 0.0], lambda prompt: {"answer": "A [1] and B [99] and C [42].", "citations": [1], "confident": True}, req)
    assert wrong["orphan_citations"] == [42, 99]
    for bad in ({"hops": 5}, {"paragraph_top_k": 51}, {"window": 6}):
        with pytest.raises(ValueError):
            answers.Request(**bad)


def test_listed_paragraphs_stay_whole():
    row = {"content": None, "heading": None, "heading_level": 0, "page_number": None}
    long = "word " * 30 + "\n\n" + "end. " * 30
    out = list(chunk_sections([row | {"paragraphs": [" a\tb\n\nc ", long, "d", "e"]}], ChunkOptions(20, 0)))
    assert [c["content"] for c in out] == [" a\tb\n\nc ", long, "d\n\ne"]
    assert list(chunk_sections([row | {"paragraphs": []}], ChunkOptions(20, 0))) == []


def test_long_turns_are_chunks_as_in_their_sql(spark, tmp_path):
    import duckdb
    from quillgraph.plans import catalog, catalog_rows  # noqa: F401

    turns = [(1, t, "user", x) for t, x in enumerate(["short", "long words " * 300, "a\n\nb", "x" * 1990, "last"])] + [(2, 0, "user", "y " * 2500), (3, 0, "user", "one"), (3, 2, "user", "after a gap"), (4, 1, "user", "no first")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = catalog.QUERIES["chunk_packs_paragraphs"](spark, str(tmp_path)).collect()
    want = duck.execute(catalog.ORACLES["chunk_packs_paragraphs"]).fetchall()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 3
