import json
import time

import pytest
from pyspark.sql import functions as F

from citeloom.operators.bibliography import build_query, split_entries
from citeloom.operators.configs import validate_configs
from citeloom.schemas import ARTICLE
from citeloom.sources.accounts import (
    read_group_members,
    read_memberships,
    read_organizations,
    read_registered_users,
)
from citeloom.sources.articles import (
    duplicates_path,
    read_article_files,
    read_written_articles,
    rejected_article_files,
    write_articles,
    write_csv,
    write_documents,
    write_duplicates,
)
from citeloom.sources.bibliography import read_bib_entries
from citeloom.sources.configs import parse_configs, read_query_configs
from citeloom.sources import inventory
from citeloom.sources.files import file_inventory
from citeloom.sources.inventory import changed_folders, present_files, record_listing
from tests.helpers import rows


def _put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")
    return str(folder)


def test_read_article_files(spark, tmp_path):
    record = {"pmid": 7, "title": "Ü \n", "impact_factor": -1, "extra": 1}
    folder = _put(
        tmp_path / "m",
        a__json=json.dumps([record, {"pmid": "8", "impact_factor": 2.5}], indent=2),
        b__json=json.dumps([record]),
        empty__json="[]",
        object__json=json.dumps(record),
        broken__json='[{"pmid": 1}, {"pmid"',
        blank__json=" ",
        notes__txt="[]",
    )
    got = read_article_files(spark, folder)
    assert got.columns == [*ARTICLE.fieldNames(), "file_name"]
    assert rows(got, "file_name", "pmid", "impact_factor") == [
        ("a.json", 7, -1.0),
        ("a.json", 8, 2.5),
        ("b.json", 7, -1.0),
    ]
    assert got.where("pmid = 7").first().title == "Ü \n"
    assert rows(rejected_article_files(spark, folder)) == [
        ("blank.json", "not a list"),
        ("broken.json", "malformed"),
        ("object.json", "not a list"),
    ]


def test_missing_folder_reads_as_empty(spark, tmp_path):
    got = read_article_files(spark, str(tmp_path / "none"))
    assert got.count() == 0 and got.columns[-1] == "file_name"
    assert rejected_article_files(spark, str(tmp_path / "none")).count() == 0


def test_json_array_files_are_valid(spark, tmp_path):
    out = tmp_path / "out"
    articles = spark.range(0, 10, 1, 3).select(
        F.col("id").alias("pmid"), F.when(F.col("id") != 3, 'x,\n]"').alias("title")
    )
    write_articles(articles, str(out), "json_array")
    arrays = [json.loads(f.read_text()) for f in out.glob("part-*")]
    assert sorted(r["pmid"] for a in arrays for r in a) == list(range(10))
    assert {"pmid": 3, "title": None} in [r for a in arrays for r in a]
    for layout in ("any", "lines"):
        got = read_article_files(spark, str(out), layout, "part-*")
        assert rows(got, "pmid") == [(i,) for i in range(10)]
        assert got.where("pmid = 4").first().title == 'x,\n]"'


def test_indented_files_are_read_in_splits(spark, tmp_path):
    records = [{"pmid": i, "title": "x\n  {" + "y" * 50, "impact_factor": 1.5} for i in range(400)]
    folder = _put(tmp_path / "m", a__json=json.dumps(records, indent=2), b__json="[]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    got = read_article_files(spark, folder, "indented")
    assert got.rdd.getNumPartitions() > 3
    assert rows(got, "pmid", "title") == [(r["pmid"], r["title"]) for r in records]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    _put(tmp_path / "m", c__json='[\n  {\n    "pmid": 1\n  },\n  {\n    "pmid": \n  }\n]')
    assert read_article_files(spark, folder, "indented").where("file_name = 'c.json'").count() == 1
    assert rows(rejected_article_files(spark, folder, "indented")) == [("c.json", "malformed")]


def test_empty_results_are_still_written(spark, tmp_path):
    none = spark.range(3).where("id > 5")
    write_articles(none, str(tmp_path / "a"), "json_array")
    assert {json.dumps(json.loads(f.read_text())) for f in (tmp_path / "a").glob("part-*")} == {"[]"}
    write_articles(none, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["id"]


def test_write_csv(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, 'a,"b"')], "n int, s string").coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_text()
    assert text.splitlines()[0] == "n,s"


def test_write_duplicates_only_if_any(spark, tmp_path):
    out = str(tmp_path / "r.json")
    assert duplicates_path(out) == str(tmp_path / "r_duplicated")
    assert not write_duplicates(spark.range(0), out)
    assert not (tmp_path / "r_duplicated").exists()
    assert write_duplicates(spark.range(2), out)
    assert spark.read.parquet(duplicates_path(out)).count() == 2


def test_write_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a", "u", bytearray(b"\x00%PDF"))], "name string, url string, content binary")
    write_documents(docs, str(tmp_path / "d"))
    row = spark.read.parquet(str(tmp_path / "d")).first()
    assert bytes(row.content) == b"\x00%PDF" and len(row.md5) == 32


def test_bibliography(spark, tmp_path):
    text = """% a comment {x}
@string{pmid = {9}}
@article{one, title={A}, pmid = {11}, url={https://pubmed.org/12}
}
  @book{two, PMID = "13"}
@misc{three, url = "https://pubmed.org/"}\r
@comment{ pmid = {1} }
@article{four, title={a@b}, pmid = 11}
"""
    folder = _put(tmp_path / "b", refs__bib=text, other__bib="@article{x, url={https://x.org}}")
    entries = read_bib_entries(spark, folder)
    got = entries.where("file_name = 'refs.bib'").orderBy("pos").select("pmid", "url")
    assert [tuple(r) for r in got.collect()] == [
        ("11", "https://pubmed.org/12"),
        ("13", None),
        (None, "https://pubmed.org/"),
        ("11", None),
    ]
    assert rows(build_query(entries), "file_name", "query_str", "download_pdf") == [
        ("other.bib", "", False),
        ("refs.bib", "11 OR 12 OR 13 OR  OR 11", False),
    ]
    strict = build_query(entries, strict=True).where("file_name = 'refs.bib'").first()
    assert strict.query_str == "11 OR 12 OR 13 OR 11"


def test_large_bibliography_gives_one_query(spark, tmp_path):
    text = "".join(f"@article{{k{i},\n  pmid = {{{i}}}\n}}\n" for i in range(3000))
    folder = _put(tmp_path / "b", refs__bib=text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    queries = build_query(read_bib_entries(spark, folder)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [q.query_str for q in queries] == [" OR ".join(map(str, range(3000)))]


def test_entries_end_where_their_braces_end(spark, tmp_path):
    inner = "@article{a, abstract={x\n@home is\n@misc{y, pmid={1}}\nz}, pmid={{11}}\n}\n@book{b, pmid=12}"
    broken = "@article{a, title={x, pmid = 3\n@book{b, pmid={4}}"
    folder = _put(tmp_path / "b", inner__bib=inner, broken__bib=broken)
    got = build_query(read_bib_entries(spark, folder))
    assert rows(got, "file_name", "query_str") == [("broken.bib", "4"), ("inner.bib", "11 OR 12")]


def test_compact_and_split_arrays_lose_no_record(spark, tmp_path):
    records = [{"pmid": i, "title": f"{{[t], {i}"} for i in range(5)]
    lines = "[" + ",\n".join(json.dumps(r) for r in records) + "]"
    folder = _put(
        tmp_path / "m", a__json=json.dumps(records), b__json=json.dumps(records, indent=2), c__json=lines
    )
    for layout, names in (("lines", "ac"), ("indented", "ab"), ("any", "abc")):
        found = read_article_files(spark, folder, layout).select("file_name", "pmid", "title")
        for name in names:
            mine = rows(found.where(f"file_name = '{name}.json'"), "pmid", "title")
            assert mine == [(r["pmid"], r["title"]) for r in records], (layout, name)
    bad = _put(tmp_path / "n", a__json='[{"pmid": 1},\n{"pmid" 2},\n{"pmid": 3}]')
    assert rows(read_article_files(spark, bad, "lines"), "pmid") == [(1,), (3,)]
    assert rejected_article_files(spark, bad, "lines").count() == 1


def test_next_run_reads_what_a_run_has_written(spark, tmp_path):
    one = spark.createDataFrame([{"pmid": 7, "title": "t"}], ARTICLE)
    folder = str(tmp_path / "out")
    assert read_written_articles(spark, folder).count() == 0
    write_articles(one, f"{folder}/first run.json")
    write_duplicates(one.select("*"), f"{folder}/second.json")
    got = rows(read_written_articles(spark, folder), "file_name", "pmid")
    assert got == [("first run.json", 7), ("second_duplicated", 7)]


def test_yaml_values(spark):
    cases = {
        "query_str: |\n  a OR\n  b\nauthor: x": "a OR\nb",
        "query_str: >-\n  a OR\n  b\n\nauthor: x": "a OR b",
        "query_str: asthma AND\n  (dust OR\n  pollen) # all\nauthor: x": "asthma AND (dust OR pollen)",
        'query_str: "asthma\n  AND dust"\n': "asthma AND dust",
        'query_str: "a \\"b\\" # c" # d': 'a "b" # c',
        "query_str: 'it''s' # x": "it's",
        "query_str: \"open": None,
        "query_str: [a, b]": None,
        "query_str: ~": None,
        "query_str:\n  plain below": "plain below",
        "query_str: a#b": "a#b",
    }
    files = spark.createDataFrame(
        [(f"/d/p/config/{i:02d}.yaml", text) for i, text in enumerate(cases)], "path string, value string"
    )
    got = parse_configs(files).orderBy("path").select("query_str").collect()
    assert [r[0] for r in got] == list(cases.values())


def test_query_configs(spark, tmp_path):
    root = tmp_path / "root"
    _put(
        root / "p" / "config",
        a__json='{"query_str": "it\'s", "author": "Me", "download_pdf": true}',
        b__yaml="# c\nquery_str: 12 OR 13 # all\nauthor: 'A # B'\ndownload_pdf: no\n",
        c__yaml='query_str: ""\n',
        d__json='{"query_str": 1',
        e__json="[1]",
        f__yml="query_str: x",
        g__bib="@article{k, pmid = {5}, url={http://pubmed/6}}",
        h__json='{"author": "Me"}',
        i__yaml="query_str: x: y\nauthor: ~",
        j__json='{"query_str": 77}',
        taken__json='{"query_str": ""}',
    )
    _put(root / "p" / "config" / "deep", z__json='{"query_str": "x"}')
    configs = read_query_configs(spark, str(root)).withColumn("path", F.replace("path", F.lit("file:"), F.lit("")))
    existing = spark.createDataFrame([(f"{root}/p/metadata/taken.json",)], "path string")
    requests, rejects = validate_configs(configs, existing, str(root))
    name = F.substring_index("path", "/", -1).alias("name")
    assert rows(requests.select(name, "query_str", "author", "download_pdf")) == [
        ("a.json", 'it"s', "Me", True),
        ("b.yaml", "12 OR 13", "A # B", False),
        ("g.bib", "5 OR 6", "Anonymous", False),
        ("i.yaml", "x: y", "Anonymous", False),
        ("j.json", "77", "Anonymous", False),
    ]
    assert rows(rejects.select(name, "reason")) == [
        ("c.yaml", "empty_query"),
        ("d.json", "config_unreadable"),
        ("e.json", "config_unreadable"),
        ("f.yml", "config_bad_format"),
        ("h.json", "empty_query"),
        ("taken.json", "destination_exists"),
        ("z.json", "config_missing"),
    ]
    assert requests.where(name == "b.yaml").first().destination == f"{root}/p/metadata/b.json"


def test_file_inventory(spark, tmp_path):
    folder = _put(tmp_path / "f", a__pdf="12345", b__html="x")
    _put(tmp_path / "f" / "sub", c__pdf="1", empty__pdf="")
    assert rows(file_inventory(spark, folder, ".pdf"), "name", "length") == [("a.pdf", 5), ("c.pdf", 1)]


def test_account_files(spark, tmp_path):
    users = _put(tmp_path / "u", users__json='{"accessKey": "a"}\n\n{"accessKey": "b", "status": "ok"}\n', none__json="")
    assert rows(read_registered_users(spark, users), "accessKey") == [("a",), ("b",)]
    orgs = _put(tmp_path / "o", o__json=json.dumps([{"id": 1, "title": "T", "created_by": 2}], indent=1))
    assert rows(read_organizations(spark, orgs)) == [(1, "T", 2)]
    page = {"count": 1, "next": None, "results": [{"id": 5, "organization": 1, "user": {"id": 9, "email": "e", "is_superuser": False}}]}
    pages = _put(tmp_path / "m", p1__json=json.dumps(page, indent=1), p2__json='{"count": 0, "results": []}')
    assert rows(read_memberships(spark, pages), "organization", "id", "email", "is_superuser") == [(1, 9, "e", False)]
    groups = _put(tmp_path / "g", a__json='{"groupName": "g",\n "members": ["x", "y"]}', b__json='{"groupName": "h"}')
    assert rows(read_group_members(spark, groups)) == [("g", "x"), ("g", "y")]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_written_tables_read_back(spark, tmp_path, format):
    write_articles(spark.range(3), str(tmp_path / "t"), format)
    assert spark.read.format(format).load(str(tmp_path / "t")).count() == 3


def test_text_behind_an_array_or_object_is_rejected(spark, tmp_path):
    good, more = '[{"pmid": "1"}]', [" trailing", "]", "}", ",[]", ", [2]", "[", "{"]
    (tmp_path / "good.json").write_text(f"\n {good} \n")
    for i, text in enumerate(more):
        (tmp_path / f"bad{i}.json").write_text(good + text)
    assert rows(read_article_files(spark, str(tmp_path)), "file_name", "pmid") == [("good.json", 1)]
    broken = rows(rejected_article_files(spark, str(tmp_path)), "file_name", "reason")
    assert broken == [(f"bad{i}.json", "malformed") for i in range(len(more))]
    texts = [("/r/p/config/a.json", '{"query_str": "x"}' + x) for x in ("", " ", "}", " y", ",{}", "]")]
    configs = parse_configs(spark.createDataFrame(texts, "path string, value string"))
    assert [r["readable"] for r in configs.collect()] == [True, True, False, False, False, False]


def test_nested_entries_take_no_longer(spark):
    """Braces are counted in linear time: one nested entry, or one entry of very many fields."""

    def seconds(text):
        files = spark.createDataFrame([("f", text)], "file_name string, value string").cache()
        files.count()
        start = time.perf_counter()
        found = split_entries(files).agg(F.count("*"), F.sum("pmid")).first()
        return time.perf_counter() - start, tuple(found)

    def entries(nested):
        note = " note = {\n@b{c}},\n"
        return "".join(f"@article{{k{i},\n title = {{A {{B}}, c}},\n{note if i == nested else ''} pmid = {{{i}}}\n}}\n" for i in range(20_000))

    seconds(entries(None))
    plain, count = seconds(entries(None))
    nested, again = seconds(entries(10_000))
    assert count == again == (20_000, 199_990_000)
    assert nested < 2 * plain + 1
    fields = "".join(f" f{i} = {{x {{y, pmid = {{1}}}}, w}},\n" for i in range(20_000))
    wide, found = seconds(f"@article{{k,\n{fields} pmid = {{7}}\n}}\n")
    assert found == (1, 7) and wide < 20


def test_depths_are_counted_anew_after_too_many_ends(spark):
    text = "@a{x, pmid={1}}}}\n@b{y, pmid={2}}\n@c{z, note={\n@d{in}\n}, pmid={3}}\n@e{w, pmid={4}}"
    for value, ids in ((text, ["1", "2", "3", "4"]), (text + "\n@f{open, pmid={5}", ["1", "2", None, "3", "4", "5"])):
        files = spark.createDataFrame([("f", value)], "file_name string, value string")
        assert [r["pmid"] for r in split_entries(files).orderBy("pos").collect()] == ids
    files = spark.createDataFrame([("f", "no entry"), ("g", ""), ("h", None)], "file_name string, value string")
    assert split_entries(files).isEmpty()


def test_arrays_of_any_layout_are_read_in_splits(spark, tmp_path):
    """The same records from every layout, however small the splits are."""
    odd = ['a "quoted" } text', "brace { and ] [", "back\\\\slash \\", 'end\\"}', "line\n}\n, {", "é ü 漢", ""]
    records = [{"pmid": str(i + 1), "title": odd[i % len(odd)], "abstract": "x" * (i % 90)} for i in range(300)]
    nested = [dict(r, extra={"a": [{"b": "}"}]}) for r in records]
    files = {
        "compact.json": json.dumps(records, separators=(",", ":")),
        "indented.json": json.dumps(records, indent=2, ensure_ascii=False),
        "lines.json": "[" + "\n,".join(json.dumps(r) for r in records) + "]\n",
        "nested.json": "\n " + json.dumps(nested, indent=1),
        "empty.json": " [ ]\n",
    }
    broken = {
        "behind.json": json.dumps(records) + " x",
        "two.json": json.dumps(records) + json.dumps(records),
        "open.json": json.dumps(records)[:-1],
        "cut.json": json.dumps(records)[:-9],
        "comma.json": json.dumps(records).replace("}, {", "} {", 1),
        "object.json": json.dumps(records[0]),
        "number.json": "[1, " + json.dumps(records[0]) + "]",
        "inner.json": json.dumps(records).replace('"pmid": "7"', '"pmid": 7"'),
        "none.json": "nothing",
    }
    for name, text in {**files, **broken}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size)
        try:
            got = read_article_files(spark, str(tmp_path), "split")
            for name in files:
                want = [] if name == "empty.json" else sorted((int(r["pmid"]), r["title"], r["abstract"]) for r in records)
                assert rows(got.where(F.col("file_name") == name), "pmid", "title", "abstract") == want, name
            assert rows(got.where(~F.col("file_name").isin(list(files)))) == []
            rejected = rows(rejected_article_files(spark, str(tmp_path), "split"))
            assert rejected == sorted((name, "malformed") for name in broken)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert read_article_files(spark, f"{tmp_path}/none", "split").columns == got.columns


def test_large_files_are_not_parsed_as_one_text(spark, tmp_path):
    """Large arrays give the records of small ones, by many tasks; odd ones still parse."""
    many = [{"pmid": str(i), "title": f"{'}' * (i % 9 == 0)} {i}", "abstract": f"{i} " * 400} for i in range(1200)]
    text = json.dumps(many)
    files = {
        "good.json": text,
        "nulls.json": text.replace("}, {", "}, null, {", 1),
        "quotes.json": text.replace('"pmid": "7"', "'pmid': '7'"),
        "cut.json": text[:-9],
        "feed.json": text + "\f",
        "object.json": '{"all": ' + text + "}",
        "small.json": json.dumps(many[:2]),
        "bad.json": "[1]",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = read_article_files(spark, str(tmp_path))
        alone = read_article_files(spark, str(tmp_path), pattern="good*")
        whole = max(r[0] for r in alone.groupBy(F.spark_partition_id()).count().select("count").collect())
        assert whole < len(many)
        for name in files:
            want = {"small.json": many[:2]}.get(name, many if name in ("good.json", "nulls.json", "quotes.json") else [])
            found = rows(got.where(F.col("file_name") == name), "pmid", "title", "abstract")
            assert found == sorted((int(r["pmid"]), r["title"], r["abstract"]) for r in want), name
        assert rows(rejected_article_files(spark, str(tmp_path))) == [
            ("bad.json", "malformed"),
            ("cut.json", "malformed"),
            ("feed.json", "malformed"),
            ("object.json", "not a list"),
        ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inventory_log_lists_changed_folders_only(spark, tmp_path, monkeypatch):
    root, log = tmp_path / "root", f"{tmp_path}/log"

    def put(name, text="x"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    def present():
        return rows(present_files(spark, log), "name", "length")

    for name in ("p/pdf/a.pdf", "p/pdf/b.pdf", "q/pdf/c.pdf", "q/html/d.html"):
        put(name)
    url = f"file:{root}"
    assert present() == []
    assert record_listing(spark, log, [url], 1, ".pdf").count() == 3
    asked = []
    listed = inventory.file_inventory
    monkeypatch.setattr(inventory, "file_inventory", lambda s, path, suffix: asked.append(path) or listed(s, path, suffix))
    put("p/pdf/b.pdf", "longer")
    put("p/pdf/e.pdf")
    (root / "p/pdf/a.pdf").unlink()
    put("q/pdf/unseen.pdf")
    events = spark.createDataFrame([(f"{url}/p/pdf/{x}.pdf",) for x in "abe"], "path string")
    folders = [r["folder"] for r in changed_folders(events).collect()]
    for _ in range(2):
        changes = record_listing(spark, log, folders, 2, ".pdf")
        assert rows(changes, "name", "length", "present") == [("a.pdf", 1, False), ("b.pdf", 6, True), ("e.pdf", 1, True)]
        assert present() == [("b.pdf", 6), ("c.pdf", 1), ("e.pdf", 1)]
    assert asked == [f"{url}/p/pdf"] * 2
    (root / "p/pdf/b.pdf").unlink()
    (root / "p/pdf/e.pdf").unlink()
    (root / "p/pdf").rmdir()
    assert record_listing(spark, log, [f"{url}/p/pdf", url], 3, ".pdf").count() == 3
    assert present() == [("c.pdf", 1), ("unseen.pdf", 1)]
    assert rows(present_files(spark, log)) == rows(file_inventory(spark, url, ".pdf"))
