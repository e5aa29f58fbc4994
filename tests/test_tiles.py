"""A service that refuses large boxes, asked tile by tile."""

import json
import re
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sitewise.sources.overpass import fetch_elements, fetch_pois, halves

BOX = (37.55, 55.72, 37.65, 55.78)


def places():
    """(tags, kind, id, lon, lat, reach): some on the borders of halves, one of both tags, ways that reach into several tiles."""
    for k in range(120):
        lon, lat = 37.55 + (k * 37 % 101) / 1010, 55.72 + (k * 53 % 97) / 1617
        yield ["clinic"] if k % 3 else ["hospital"], "node" if k % 4 else "way", k, lon, lat, 0.004 if k % 4 == 0 else 0.0
    yield ["clinic", "hospital"], "node", 500, 37.6, 55.75, 0.0
    yield ["clinic"], "node", 501, 37.6, 55.73, 0.0
    yield ["clinic"], "node", 502, 37.575, 55.75, 0.0


class Service:
    """most: elements of an answer at most, else it refuses in one of three ways."""

    def __init__(self, most):
        self.most, self.asked, self.refused, self.failures = most, [], 0, 0

    def answer(self, query):
        tag = re.search(r'="(\w+)"', query)[1]
        south, west, north, east = map(float, re.search(r"\(([\d.,]+)\);", query)[1].split(","))
        self.asked.append((tag, west, south, east, north))
        found = [
            {"type": kind, "id": i, "tags": {"amenity": tag, "name": f"n{i}"}} | ({"center": {"lat": lat, "lon": lon}} if kind == "way" else {"lat": lat, "lon": lon})
            for tags, kind, i, lon, lat, far in places() if tag in tags and west - far <= lon <= east + far and south - far <= lat <= north + far
        ]
        if len(found) > self.most:
            self.refused += 1
            return (504, {}) if self.refused % 3 == 0 else (413, {}) if self.refused % 3 == 1 else (200, {"elements": found[:3], "remark": "runtime error: Query timed out"})
        if len(self.asked) % 5 == 0:
            self.failures += 1
            return 500, {}
        return 200, {"elements": found}


@pytest.fixture
def served():
    servers = []

    def start(most):
        service = Service(most)

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers["Content-Length"])).decode()
                code, made = service.answer(urllib.parse.parse_qs(body)["data"][0])
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(made).encode())

            def log_message(self, *args):
                pass

        servers.append(ThreadingHTTPServer(("127.0.0.1", 0), Handler))
        threading.Thread(target=servers[-1].serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{servers[-1].server_port}", service

    yield start
    for s in servers:
        s.shutdown()


def test_halves():
    assert halves(*BOX) == [(37.55, 55.72, 37.65, 55.75), (37.55, 55.75, 37.65, 55.78)]
    assert halves(0.0, 0.0, 4.0, 1.0) == [(0.0, 0.0, 2.0, 1.0), (2.0, 0.0, 4.0, 1.0)]


def test_tiles_give_what_the_undivided_box_gives(spark, served):
    found = {}
    for most in (10_000, 9):
        url, service = served(most)
        rows = fetch_elements(spark, BOX, ["amenity=clinic", "amenity=hospital"], url, retries=3, pause_s=0.01).collect()
        found[most] = sorted((r["type"], r["id"], r["lat"], r["lon"], r["center"]) for r in rows)
        assert len({r[:2] for r in found[most]}) == len(rows)
        assert (service.refused > 10) == (most == 9) and service.failures > 0 or most > 9
    assert found[9] == found[10_000] and len(found[9]) == 123
    url, _ = served(9)
    table = fetch_pois(spark, BOX, ["amenity=clinic"], url, exclude_name_keywords=["n501"], retries=3, pause_s=0.01)
    assert table.count() == len({i for tags, _, i, *_ in places() if "clinic" in tags}) - 1


def test_a_box_that_is_always_refused_is_an_error(spark, served, monkeypatch):
    url, service = served(-1)
    with pytest.raises(Exception, match="refused even for"):
        fetch_elements(spark, (37.6, 55.75, 37.6003, 55.7501), ["amenity=clinic"], url, retries=1, pause_s=0.0).collect()


def test_no_answer_in_time_halves_too(spark):
    slow = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            south, west, north, east = map(float, re.search(r"\(([\d.,]+)\);", urllib.parse.parse_qs(body)["data"][0])[1].split(","))
            if east - west > 0.06 and north - south > 0.04:
                slow.append(1)
                time.sleep(1.5)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 55.75, "lon": 37.6}]}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = fetch_elements(spark, BOX, ["amenity=clinic"], f"http://127.0.0.1:{server.server_port}", retries=1, pause_s=0.0, timeout_s=0.5).collect()
    server.shutdown()
    assert slow and len(got) == 1
