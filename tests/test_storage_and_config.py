import datetime
import json

import pytest
from pyspark.sql import functions as F

from harrow import cli, config, logs
from harrow.sources import records, sinks, sqlite

TRICKY = 'a, "b"\nnext\tend\t'
META = {"title": "t", "description": "ü", "keywords": ""}
TIME = datetime.datetime(2024, 1, 2, 3, 4, 5, 678000)


@pytest.fixture
def stored(spark):
    rows = [(f"http://h.test/{i}", TRICKY, "te xt", ["http://x.test/", "http://y.test/"], META, TIME, 200 + i, None if i == 1 else "text/html") for i in range(3)]
    return records.to_record(spark.createDataFrame(rows, records.DDL))


def same(a, b, content=True):
    pick = [c for c in records.FIELDS if content or c != "content_type"]
    return sorted(map(str, a.select(*pick).collect())) == sorted(map(str, b.select(*pick).collect()))


def test_round_trips(spark, stored, tmp_path):
    records.write_jsonl(stored, f"{tmp_path}/j")
    assert same(records.read_json(spark, f"{tmp_path}/j"), stored)
    records.write_json_array(stored, f"{tmp_path}/a.json")
    assert len(json.loads((tmp_path / "a.json").read_text())) == 3 and same(records.read_json(spark, f"{tmp_path}/a.json"), stored)
    records.write_csv(stored, f"{tmp_path}/c")
    assert same(records.read_csv(spark, f"{tmp_path}/c"), stored, content=False)
    records.write_csv(stored, f"{tmp_path}/w.csv", delimiter=";", encoding="cp1251")
    assert records.read_csv(spark, f"{tmp_path}/w.csv", delimiter=";", encoding="cp1251").first()["title"] == TRICKY
    sqlite.write_sqlite(stored, f"{tmp_path}/p.db")
    assert same(sqlite.read_sqlite(spark, f"{tmp_path}/p.db"), stored)


def test_upsert_keeps_the_id(spark, stored, tmp_path):
    path = f"{tmp_path}/p.db"
    sqlite.write_sqlite(stored, path)
    sqlite.write_sqlite(stored.limit(1).selectExpr("url", "'new' as title", *records.FIELDS[2:]), path)
    sqlite.register(spark)
    got = spark.read.format("harrow_sqlite").option("path", path).load().collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3] and sum(r["title"] == "new" for r in got) == 1
    pages = sqlite.read_sqlite(spark, path)
    assert sqlite.query(spark, "SELECT count(*) AS n FROM pages WHERE status_code >= ?", [201], pages) == [{"n": 2}]


def test_a_failing_sink_counts_and_goes_on(spark, stored):
    class Bad(sinks.Sink):
        def _write(self, batch):
            raise OSError("full")

    class Good(sinks.Sink):
        def _write(self, batch):
            pass

    both = sinks.Multi(Bad(delay=0.0, batch_size=3), Good(batch_size=2))
    assert both.save(stored) is False
    assert both.stats()["sinks"] == [{"saved": 0, "failed": 3, "batches": 0, "write_errors": 3, "buffered": 0}, {"saved": 2, "failed": 0, "batches": 1, "write_errors": 0, "buffered": 1}]
    both.close()
    assert both.stats()["sinks"][1] == {"saved": 3, "failed": 0, "batches": 2, "write_errors": 0, "buffered": 0}


def test_batches_wait_until_they_are_full(spark, tmp_path):
    rows = spark.range(25).selectExpr("concat('http://h.test/', id) as url")
    sink = sinks.JsonLines(f"{tmp_path}/j", batch_size=10)
    sink.save(rows)
    assert (sink.stats()["batches"], sink.stats()["saved"], sink.stats()["buffered"]) == (2, 20, 5)
    sink.save(rows.limit(3))
    assert (sink.stats()["batches"], sink.stats()["buffered"]) == (2, 8)
    sink.close()
    assert (sink.stats()["batches"], sink.stats()["saved"], sink.stats()["buffered"]) == (3, 28, 0)
    assert records.read_json(spark, f"{tmp_path}/j").count() == 28


def test_csv_of_the_factory_has_a_byte_order_mark(spark, stored, tmp_path):
    sink = sinks.make_sink("csv", f"{tmp_path}/c", batch_size=2)
    sink.save(stored)
    sink.close()
    parts = list((tmp_path / "c").glob("part-*"))
    assert parts and all(p.read_bytes().startswith(b"\xef\xbb\xbfurl,") for p in parts)
    assert same(records.read_csv(spark, f"{tmp_path}/c", encoding="utf-8-sig"), stored, content=False)


def test_last_of_equal_times_wins_in_sqlite(spark, stored, tmp_path):
    twice = stored.limit(1).unionByName(stored.limit(1).selectExpr("url", "'later' as title", *records.FIELDS[2:])).coalesce(1)
    sqlite.write_sqlite(twice, f"{tmp_path}/p.db")
    assert [r["title"] for r in sqlite.read_sqlite(spark, f"{tmp_path}/p.db").collect()] == ["later"]


def test_public_names():
    import harrow

    assert all(getattr(harrow, name) is not None for name in harrow.__all__)
    with pytest.raises(AttributeError):
        harrow.no_such_name  # noqa: B018


def test_sink_factory(spark, stored, tmp_path):
    assert sinks.type_of("x.sqlite") == "sqlite" and sinks.make_sink("none", None) is None
    with pytest.raises(ValueError, match="extension"):
        sinks.type_of("x.txt")
    s = sinks.make_sink("json", f"{tmp_path}/e.json", overwrite=True)
    s.close()
    assert (tmp_path / "e.json").read_text() == "[]"
    s = sinks.make_sink("json", f"{tmp_path}/e.json", overwrite=True)
    s.save(stored)
    s.save(stored)
    s.close()
    assert len(json.loads((tmp_path / "e.json").read_text())) == 6


@pytest.mark.parametrize(
    ("data", "names"),
    [({"limts": {}}, "limits"), ({"limits": {"max_page": 1}}, "max_pages"), ({"limits": {"max_pages": "x"}}, "limits.max_pages"), ({"limits": {"max_pages": True}}, "limits.max_pages"), ({"storage": {"type": "xml"}}, "storage.type"), ({"filters": {"include_patterns": ["("]}}, "include_patterns"), ({"crawler": {"rate_limit": 0}}, "rate_limit")],
)
def test_wrong_settings_name_the_key(data, names):
    with pytest.raises(config.ConfigError, match=names):
        config.from_dict(data)


def test_yaml_equals_json_and_flags_win(tmp_path):
    (tmp_path / "c.yaml").write_text("start_urls: [http://h.test/]\nlimits: {max_pages: 7}\ncrawler: {rate_limit: 3}\n")
    (tmp_path / "c.json").write_text(json.dumps({"start_urls": ["http://h.test/"], "limits": {"max_pages": 7}, "crawler": {"rate_limit": 3}}))
    assert config.load(f"{tmp_path}/c.yaml") == config.load(f"{tmp_path}/c.json")
    c = cli.config_of(cli.parser().parse_args(["--config", f"{tmp_path}/c.json", "--max-pages", "9", "--output", "p.csv", "--no-respect-robots"]))
    assert (c.limits.max_pages, c.storage.type, c.crawler.rate_limit, c.crawler.respect_robots) == (9, "csv", 3.0, False)
    assert cli.main([]) == 2 and cli.main(["--config", f"{tmp_path}/none.yaml"]) == 2


def test_log_lines(tmp_path):
    log = logs.setup(file=f"{tmp_path}/l.log", format="json")
    try:
        raise KeyError("x")
    except KeyError:
        log.exception("bad")
    said = json.loads((tmp_path / "l.log").read_text())
    assert said["level"] == "ERROR" and said["message"] == "bad" and "KeyError" in said["exception"]
    logs.setup()


def test_lenient_settings(tmp_path):
    c = config.from_dict({"start_urls": "http://h.test/", "logging": {"level": "info"}, "crawler": {"user_agents": ["a"]}})
    assert c.start_urls == ["http://h.test/"]
    logs.setup(level=c.logging.level, console_level="error", file=f"{tmp_path}/l.log")
    logs.setup()
    for wrong in ({"crawler": {"user_agents": ["a", " "]}}, {"start_urls": ["ftp://h.test/"]}, {"start_urls": [1]}):
        with pytest.raises(config.ConfigError):
            config.from_dict(wrong)


class Picky(sinks.JsonLines):
    """Refuses batches with certain URLs; closing fails."""

    def _write(self, batch):
        if batch.filter("url like '%bad%'").count():
            raise OSError("refused")
        super()._write(batch)

    def _close(self):
        raise OSError("cannot close")


def test_a_bad_row_costs_its_batch_alone(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('http://h.test/', lpad(id, 3, '0'), case when id in (7, 30) then '-bad' else '' end) as url", "timestamp'2024-01-01' as crawled_at")
    sink = Picky(f"{tmp_path}/j", batch_size=5, retries=1, delay=0.0)
    assert sink.save(rows) is False
    assert (sink.stats()["saved"], sink.stats()["failed"], sink.stats()["batches"]) == (30, 10, 6)
    sink.close()
    sink.close()  # once is enough, and neither raises
    got = {r["url"][14:17] for r in records.read_json(spark, f"{tmp_path}/j").collect()}
    assert len(got) == 30 and "007" not in got and "008" not in got and "004" in got
    none = Picky(f"{tmp_path}/k", batch_size=1, retries=0, delay=0.0)
    none.GIVE_UP = 3
    none.save(spark.range(40).selectExpr("concat('bad', id) as url"))
    assert (none.stats()["saved"], none.stats()["failed"]) == (0, 40) and none.write_errors < 20


def test_statistics_file_has_whole_lists(spark, tmp_path):
    many = spark.range(3000).selectExpr("concat('u', lpad(id, 4, '0')) as url").orderBy("url")
    pairs = spark.createDataFrame([("a", 1.5), ("b", None)], "domain string, backoff double")
    sinks.write_stats_json({"totals": {"n": 1}, "permanent_urls": ["u0"]}, f"{tmp_path}/s.json", {"permanent_urls": many, "backoff": pairs, "none": pairs.limit(0)})
    said = json.loads((tmp_path / "s.json").read_text())
    assert said["totals"] == {"n": 1} and len(said["permanent_urls"]) == 3000 and said["permanent_urls"][2999] == "u2999"
    assert said["backoff"] == [{"domain": "a", "backoff": 1.5}, {"domain": "b", "backoff": None}] and said["none"] == []
    sinks.write_stats_json({}, f"{tmp_path}/t.json", {"none": pairs.limit(0)})
    assert json.loads((tmp_path / "t.json").read_text()) == {"none": []}


def test_code_page_files_are_read_in_parallel(spark, stored, tmp_path):
    """Two files in windows-1251 with line breaks, quotes and delimiters inside cells."""
    (tmp_path / "c").mkdir()
    odd = stored.withColumn("title", F.lit('Заголовок; "да"\nвторая строка'))
    for k in range(2):
        records.write_csv(odd.withColumn("url", F.concat("url", F.lit(f"#{k}"))), f"{tmp_path}/c/{k}.csv", delimiter=";", encoding="cp1251")
    got = records.read_csv(spark, f"{tmp_path}/c", delimiter=";", encoding="cp1251")
    assert got.count() == 2 * stored.count() and {r["title"] for r in got.collect()} == {'Заголовок; "да"\nвторая строка'} and got.rdd.getNumPartitions() == 2
