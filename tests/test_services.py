"""The model client and a whole run against services of this process."""

import json
import struct
import threading
import urllib.error
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sitewise.config import load_config
from sitewise.operators.estimates import chat_model, estimate_cells
from sitewise.plans.siting import run_all
from test_sources_and_plan import package  # noqa: F401

REPLY = {"wealth_score": 6, "area_character": "residential", "confidence": 0.9}


@pytest.fixture
def service():
    """(address, requests seen): POIs at /pois, replies at /v1/chat/completions."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append((self.path, dict(self.headers), body))
            if self.path == "/pois":
                query = urllib.parse.parse_qs(body)["data"][0]
                kind = "clinic" if "clinic" in query else "hospital"
                made = {"elements": [
                    {"type": "node", "id": 10 + k, "lat": 55.725 + 0.004 * k, "lon": 37.555 + 0.007 * k, "tags": {"amenity": kind, "name": f"{kind} {k}"}} for k in range(6)
                ]}
            elif self.headers.get("Authorization") != "Bearer secret":
                self.send_error(401)
                return
            else:
                made = {"choices": [{"message": {"content": f"```json\n{json.dumps(REPLY)}\n```"}}]}
            raw = json.dumps(made).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_client_sends_the_prompt_and_reads_the_reply(service, monkeypatch):
    address, seen = service
    monkeypatch.setenv("TEST_MODEL_KEY", "secret")
    ask = chat_model(f"{address}/v1/", "some-model", api_key_env="TEST_MODEL_KEY", temperature=0.5)()
    assert json.loads(ask("вопрос").strip("`").removeprefix("json")) == REPLY
    path, _, body = seen[-1]
    assert path == "/v1/chat/completions"
    assert json.loads(body) == {"model": "some-model", "temperature": 0.5, "messages": [{"role": "user", "content": "вопрос"}]}
    monkeypatch.setenv("TEST_MODEL_KEY", "wrong")
    with pytest.raises(urllib.error.HTTPError):
        chat_model(f"{address}/v1", "m", api_key_env="TEST_MODEL_KEY")()("x")
    monkeypatch.delenv("TEST_MODEL_KEY")
    with pytest.raises(RuntimeError, match="TEST_MODEL_KEY"):
        chat_model(address, "m", api_key_env="TEST_MODEL_KEY")()


def test_each_batch_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def maker():
        def ask(text):
            import uuid

            (calls / uuid.uuid4().hex).write_text(text)
            return json.dumps(REPLY)

        return ask

    contexts = spark.createDataFrame([(f"c{i}", f"context {i % 25}") for i in range(100)], "cell_id string, context string")
    got = estimate_cells(contexts, maker, model_name="m", cache_path=str(tmp_path / "cache"), batch=7, tasks=2)
    assert got.where("wealth_score = 6").count() == 100
    asked = [p.read_text() for p in calls.iterdir()]
    assert len(asked) == len(set(asked)) == 25


def test_run_all(spark, service, package, tmp_path, monkeypatch):  # noqa: F811
    address, seen = service
    monkeypatch.setenv("TEST_MODEL_KEY", "secret")
    # Workers of an earlier test have no key: the environment is read in the task.
    monkeypatch.setitem(spark.sparkContext.environment, "TEST_MODEL_KEY", "secret")
    (tmp_path / "c.yaml").write_text(f"""
data:
  osm: {{overpass_url: "{address}/pois", clinic_tags: [amenity=clinic, amenity=hospital], retries: 1, retry_pause_s: 0}}
  population: {{file: "{package}"}}
estimate: {{model: m, base_url: "{address}/v1", api_key_env: TEST_MODEL_KEY, cache_dir: "{tmp_path}/cache", request_pause_s: 0, tasks: 3}}
optimize: {{budget_clinics: 3}}
output: {{processed_dir: "{tmp_path}/processed", tables_dir: "{tmp_path}/tables", maps_dir: "{tmp_path}/maps"}}
""")
    report = run_all(spark, load_config(str(tmp_path / "c.yaml"))).collect()
    assert [r["scenario"] for r in report] == ["model", "baseline_population_density"]
    assert all(r["after"] <= r["before"] and r["improvement"] == pytest.approx(r["before"] - r["after"]) for r in report)
    cells = spark.read.parquet(f"{tmp_path}/processed/cells.parquet")
    assert cells.count() == 182 and cells.where("existing_clinics > 0").count() > 0 and cells.where("population > 0").count() > 0
    for r in cells.limit(5).collect():
        found = struct.unpack("<BIII10d", bytes(r["geometry"]))
        assert found[:4] == (1, 3, 1, 5) and found[4:8] == (r["x0"], r["y0"], r["x1"], r["y0"]) and found[-2:] == (r["x0"], r["y0"])
    chosen = spark.read.option("header", True).csv(f"{tmp_path}/tables/recommendations.csv")
    assert 0 < chosen.count() <= 3 and set(chosen.select("optimal").toPandas()["optimal"]) == {"true"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/tables/validation.csv").count() == 2
    assert spark.read.text(f"{tmp_path}/maps/cells.geojson").count() == 182
    assert "const markers=" in spark.read.text(f"{tmp_path}/maps/recommendations").first()[0]
    prompts = [json.loads(body)["messages"][0]["content"] for path, _, body in seen if path != "/pois"]
    assert len(prompts) == len(set(prompts)) > 1
