"""The reply cache's commits, concurrent calls, broken-off runs and arriving cells."""

import json
import subprocess
import sys
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sitewise import schemas
from sitewise.operators.estimates import Pace, chat_model, estimate_arriving, estimate_cells, latest_estimates, replies_to
from sitewise.sources import replies
from sitewise.sources.replies import Journal, append_replies, journalled, read_cache, state

GOOD = json.dumps({"wealth_score": 6, "area_character": "residential", "confidence": 0.9})


def rows(spark, *keys):
    return spark.createDataFrame([(k, 1, "mixed", 0.5) for k in keys], schemas.CACHE)


def keys(spark, path):
    return sorted(r["key"] for r in read_cache(spark, path).collect())


@pytest.fixture
def counted(tmp_path):
    """A maker of models that note each prompt in a file of its own, and the notes."""
    notes = tmp_path / "notes"
    notes.mkdir()

    def maker(fail_after=None):
        def make():
            def ask(text):
                import uuid

                if fail_after is not None and len(list(notes.iterdir())) >= fail_after:
                    raise OSError("no answer")
                (notes / uuid.uuid4().hex).write_text(text)
                return GOOD

            return ask

        return make

    return maker, lambda: Counter(p.read_text() for p in notes.iterdir())


def test_commits_add_up(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert keys(spark, path) == [] and state(path).version == 0
    version = 0
    for k in range(23):  # over two entries that list all files
        version = append_replies(rows(spark, f"k{k:02d}"), path, version)
    assert version == 23 == state(path).version and keys(spark, path) == [f"k{k:02d}" for k in range(23)]
    assert len(state(path, 20).files) == 3 and state(path, 23).files == ()
    assert not list((tmp_path / "cache").glob("_*"))


def test_a_key_that_another_run_has_added_stays_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    append_replies(rows(spark, "a", "b"), path, 0)
    # This run still thinks that the table is empty.
    assert append_replies(rows(spark, "b", "c"), path, 0) == 2
    assert keys(spark, path) == ["a", "b", "c"]


def test_a_plain_folder_of_files_is_a_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows(spark, "old").write.parquet(path)
    assert keys(spark, path) == ["old"]
    append_replies(rows(spark, "new"), path, 0)
    assert keys(spark, path) == ["new", "old"]


def test_an_entry_of_the_log_is_made_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    kind = rows(spark).schema
    first, second = (replies.ReplyWriter({"path": path, "version": "0"}, kind) for _ in range(2))
    batch = rows(spark, "a").toArrow().to_batches()
    one, again = first.write(iter(batch)), second.write(iter(batch))
    lost = first.write(iter(batch))  # an attempt whose message never came
    first.commit([one, None])
    assert lost.names != one.names
    with pytest.raises(RuntimeError, match="another run"):
        second.commit([again])
    assert keys(spark, path) == ["a"] and len(list((tmp_path / "cache").glob("*.parquet"))) == 1


FAILING = '''
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from sitewise import schemas
from sitewise.sources import replies

class Writer(replies.ReplyWriter):
    def write(self, iterator):
        done = super().write(iterator)
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2:
            raise OSError("after the write")
        return done

class Source(replies.ReplyDataSource):
    @classmethod
    def name(cls):
        return "failing"
    def writer(self, schema, overwrite):
        return Writer(dict(self.options), schema)

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
spark.dataSource.register(Source)
table = spark.range(40).selectExpr("cast(id as string) key", "1 wealth_score", "'mixed' area_character", "0.5D confidence").repartition(6)
table.write.format("failing").mode("append").options(path=sys.argv[1], version=0).save()
found = [r["key"] for r in replies.read_cache(spark, sys.argv[1]).collect()]
assert sorted(found) == sorted(map(str, range(40))), found
spark.stop()
'''


def test_a_task_that_fails_after_its_write_adds_its_rows_once(tmp_path):
    import os

    path = str(tmp_path / "cache")
    done = subprocess.run([sys.executable, "-c", FAILING, path], capture_output=True, text=True, timeout=240, env=os.environ | {"PYTHONPATH": ":".join(p for p in sys.path if p)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(list((tmp_path / "cache").glob("*.parquet"))) <= 6 and not list((tmp_path / "cache").glob("_*"))


def test_calls_at_once_are_bounded_and_paced():
    now, most, lock = 0, 0, threading.Lock()

    def model(text):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01)
        with lock:
            now -= 1
        return text.upper()

    asked = [(str(k), f"p{k}") for k in range(60)]
    got = dict(replies_to(asked, model, concurrency=7, pace=Pace(0), call_retries=0, retry_pause_s=0))
    assert got == {k: p.upper() for k, p in asked} and 2 <= most <= 7
    began = time.monotonic()
    list(replies_to(asked[:11], model, concurrency=7, pace=Pace(0.02), call_retries=0, retry_pause_s=0))
    assert time.monotonic() - began >= 0.2


def test_only_the_failed_call_is_made_again():
    seen = Counter()

    def model(text):
        seen[text] += 1
        if text == "p3" and seen[text] < 3:
            raise OSError("no answer")
        return text

    asked = [(k, k) for k in (f"p{i}" for i in range(9))]
    assert len(list(replies_to(asked, model, concurrency=3, pace=Pace(0), call_retries=2, retry_pause_s=0))) == 9
    assert seen == {f"p{i}": 3 if i == 3 else 1 for i in range(9)}
    seen.clear()
    got = []
    with pytest.raises(OSError):
        for pair in replies_to(asked, model, concurrency=3, pace=Pace(0), call_retries=1, retry_pause_s=0):
            got.append(pair)
    # What was under way has come before the error.
    assert {k for k, _ in got} == {k for k in seen if k != "p3"}


def test_a_journal_is_found_by_later_attempts(spark, tmp_path):
    folder = str(tmp_path / "cache" / "calls" / "run")
    assert Journal(folder, "01-000002").earlier() == {}
    first = Journal(folder, "01-000002")
    first.add("a", "x\n")
    first.add("b", "y")
    (tmp_path / "cache" / "calls" / "run" / "01-000002-broken.jsonl").write_text('{"key": "c", "raw": "z"}\n{"key": "d"')
    assert Journal(folder, "01-000002").earlier() == {"a": "x\n", "b": "y", "c": "z"} and Journal(folder, "01-000001").earlier() == {}
    table, folders = journalled(spark, str(tmp_path / "cache"))
    assert {(r["key"], r["raw"]) for r in table.collect()} == {("a", "x\n"), ("b", "y"), ("c", "z")} and len(folders) == 1


def test_a_broken_off_run_asks_no_answered_prompt_again(spark, tmp_path, counted):
    maker, asked = counted
    contexts = spark.createDataFrame([(f"c{i}", f"context {i}") for i in range(60)], "cell_id string, context string")
    settings = {"model_name": "m", "cache_path": str(tmp_path / "cache"), "tasks": 2, "concurrency": 3, "call_retries": 0}
    with pytest.raises(Exception, match="no answer"):
        estimate_cells(contexts, maker(20), **settings)
    before = sum(asked().values())
    assert 20 <= before < 60 and read_cache(spark, settings["cache_path"]).count() == 0
    got = estimate_cells(contexts, maker(), **settings)
    assert got.where("wealth_score = 6").count() == 60
    assert len(asked()) == 60 and set(asked().values()) == {1}
    assert not list((tmp_path / "cache" / "calls").iterdir())


def test_a_slow_service_is_asked_at_once(spark, tmp_path, monkeypatch):
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            time.sleep(0.05)
            raw = json.dumps({"choices": [{"message": {"content": GOOD}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    class Server(ThreadingHTTPServer):
        request_queue_size = 256

    server = Server(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("TEST_MODEL_KEY", "secret")
    monkeypatch.setitem(spark.sparkContext.environment, "TEST_MODEL_KEY", "secret")
    maker = chat_model(f"http://127.0.0.1:{server.server_port}/v1", "m", api_key_env="TEST_MODEL_KEY")
    contexts = spark.createDataFrame([(f"c{i}", f"context {i}") for i in range(1000)], "cell_id string, context string").repartition(4)
    settings = {"model_name": "m", "tasks": 4, "concurrency": 24}
    estimate_cells(contexts.limit(5), maker, cache_path=str(tmp_path / "warm"), **settings)
    from sitewise.operators.estimates import call_model, with_keys

    misses = with_keys(contexts, "m").select("key", "prompt").cache()
    misses.count()
    began = time.monotonic()
    answered = call_model(misses, maker, tasks=4, concurrency=24).where("wealth_score = 6").count()
    took = time.monotonic() - began
    server.shutdown()
    misses.unpersist()
    assert answered == 1000 and took < 1000 * 0.05 / 10


def test_arriving_cells_are_asked_once(spark, tmp_path, counted):
    maker, asked = counted
    kind = "cell_id string, context string"

    def arrive(name, pairs):
        spark.createDataFrame(pairs, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(model):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = estimate_arriving(
            stream, model, output_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "checkpoint"), model_name="m", cache_path=str(tmp_path / "cache"), tasks=2, call_retries=0
        )
        query.awaitTermination()

    arrive("1", [(f"c{i}", f"context {i}") for i in range(10)])
    arrive("2", [(f"c{i}", f"context {i % 12}") for i in range(10, 20)])
    run(maker())
    assert len(asked()) == 12
    arrive("3", [(f"c{i}", f"context {i}") for i in range(20, 40)] + [("c0", "context 1")])
    with pytest.raises(Exception, match="no answer"):
        run(maker(25))
    assert 25 <= sum(asked().values()) < 32
    run(maker())  # from the checkpoint: the broken batch again
    assert set(asked().values()) == {1} and len(asked()) == 32
    got = sorted(map(tuple, latest_estimates(spark, str(tmp_path / "out")).collect()))
    whole = spark.read.schema(kind).parquet(str(tmp_path / "in")).dropDuplicates(["cell_id"])
    want = sorted(map(tuple, estimate_cells(whole, maker(), model_name="m", cache_path=str(tmp_path / "cache")).collect()))
    assert got == want and len(got) == 40
