"""A pyramid of map tiles: cell outlines with their numbers, merged level by level, a file a tile.

Tiles are the squares of the common web map: 2^z x 2^z of them at level z. At the finest level a cell is at least some pixels
wide; at each level above, blocks of twice as many cells a side stand for their cells, with sums and means. So a tile
of any level has a bounded number of outlines, and a page loads what it shows. All levels come of one pass: each cell goes to its
block of every level, blocks are added up before they are shuffled. Tiles are dealt to tasks along a space-filling curve.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.durable import qualified
from sitewise.functions.geo import MERCATOR_M, mercator_x, mercator_y
from sitewise.operators.grid import Grid
from sitewise.sources.geofile import on_curve
from sitewise.sources.staged import located

#: Cells a side of a tile at the finest level, at most.
CELLS = 16
#: Finest level of all.
DEEPEST = 20


def levels(grid: Grid) -> tuple[int, int]:
    """The level whose one tile, or few, the grid fits into, and the finest: there CELLS cells are wider than a tile."""
    world = 2 * math.pi * MERCATOR_M
    side = MERCATOR_M * math.radians(min(grid.lon_step, grid.lat_step))
    finest = min(DEEPEST, max(0, math.ceil(math.log2(world / (side * CELLS)))))
    return max(0, finest - math.ceil(math.log2(max(1, grid.rows / CELLS, grid.columns / CELLS)))), finest


def tile_of(lon: Column, lat: Column, level: Column) -> tuple[Column, Column]:
    """x and y of the tile that a place lies in, counted from the north-west corner of the world."""
    n = F.pow(F.lit(2.0), level)
    x = F.floor((mercator_x(lon) / (2 * math.pi * MERCATOR_M) + 0.5) * n)
    y = F.floor((0.5 - mercator_y(lat) / (2 * math.pi * MERCATOR_M)) * n)
    return x.cast("int"), y.cast("int")


def tile_features(cells: DataFrame, grid: Grid) -> DataFrame:
    """z, x, y, row, col, cells, population, existing_clinics, wealth_score, x0, y0, x1, y1: the blocks of each tile; row and col in blocks of their level.

    Sums of people and facilities (null: none), the mean of known wealth scores. A block is in the tile of its middle.
    """
    coarse, finest = levels(grid)
    at = cells.withColumn("z", F.explode(F.sequence(F.lit(coarse), F.lit(finest))))
    side = F.pow(F.lit(2.0), F.lit(finest) - F.col("z"))
    placed = at.withColumns({"_r": F.floor(F.col("row") / side).cast("int"), "_c": F.floor(F.col("col") / side).cast("int")})
    blocks = placed.groupBy("z", "_r", "_c").agg(
        F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("population"), F.lit(0)).alias("population"), F.coalesce(F.sum("existing_clinics"), F.lit(0)).alias("existing_clinics"),
        F.avg("wealth_score").alias("wealth_score"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    x, y = tile_of((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("z"))
    return blocks.select(
        "z", x.alias("x"), y.alias("y"), F.col("_r").alias("row"), F.col("_c").alias("col"), "cells", "population", "existing_clinics", "wealth_score", "x0", "y0", "x1", "y1"
    )


def tile_files(features: DataFrame) -> DataFrame:
    """z, x, y, body: each tile's features as one GeoJSON collection, some thousand outlines at most."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]
    ring = F.array(*[F.array(F.round(a, 6), F.round(b, 6)) for a, b in corners])
    feature = F.struct(
        F.col("row"), F.col("col"), F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct("cells", "population", "existing_clinics", F.round("wealth_score", 2).alias("wealth_score")).alias("properties"),
    )
    listed = features.groupBy("z", "x", "y").agg(F.sort_array(F.collect_list(feature)).alias("_f"))
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("_f", lambda f: f.dropFields("row", "col")).alias("features"))
    return listed.select("z", "x", "y", F.to_json(whole, {"ignoreNullFields": "false"}).alias("body"))


def write_tiles(cells: DataFrame, grid: Grid, path: str) -> tuple[int, int]:
    """Writes {z}/{x}/{y}.json by all tasks; the coarsest and the finest level. A tile's file is whole as soon as it has its name."""
    spark = cells.sparkSession
    target = qualified(spark, path)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = located(target)
        for frame in frames:
            for z, x, y, body in zip(frame["z"], frame["x"], frame["y"], frame["body"], strict=True):
                folder = f"{base}/{z}/{x}"
                fs.create_dir(folder, recursive=True)
                made = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(made) as out:
                    out.write(body.encode())
                fs.move(made, f"{folder}/{y}.json")
            yield pd.DataFrame({"n": [len(frame)]})

    files = tile_files(tile_features(cells, grid))
    dealt = files.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "z", on_curve(F.col("x"), F.col("y")))
    dealt.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return levels(grid)


# A page that draws the tiles in view on a canvas, the numbers of the outline under the pointer beside it, and the chosen places on top.
PAGE = """<!doctype html><meta charset="utf-8"><style>body{margin:0}#map{position:relative;width:100vw;height:100vh;overflow:hidden}#map *{position:absolute}
#legend,#tip{background:#fff;padding:6px;z-index:3;font:13px sans-serif}#legend{right:8px;top:8px}canvas{z-index:1}svg{z-index:2;width:100%;height:100%}</style>
<div id="map"><canvas></canvas><svg></svg><div id="legend">__LEGEND__</div><div id="tip" hidden></div></div><script>
const base=__BASE__,tiles=__TILES__,coarse=__COARSE__,finest=__FINEST__;const markers=__MARKERS__;let centre=__CENTRE__,zoom=coarse;
const map=document.getElementById("map"),canvas=map.querySelector("canvas"),svg=map.querySelector("svg"),tip=document.getElementById("tip"),loaded=new Map();let shown=[];
const across=(lon,z)=>(lon/360+.5)*256*2**z,down=(lat,z)=>(.5-Math.log(Math.tan(Math.PI/4+lat*Math.PI/360))/(2*Math.PI))*256*2**z;
const load=(z,x,y)=>{const k=`${z}/${x}/${y}`;if(!loaded.has(k))loaded.set(k,fetch(`${tiles}/${k}.json`).then(r=>r.ok?r.json():{features:[]}).catch(()=>({features:[]})));return loaded.get(k)};
async function draw(){const w=map.clientWidth,h=map.clientHeight,z=zoom,left=across(centre[0],z)-w/2,top=down(centre[1],z)-h/2;canvas.width=w;canvas.height=h;
map.querySelectorAll("img").forEach(i=>i.remove());const jobs=new Set(),own=Math.min(z,finest),d=2**(z-own);
for(let x=Math.floor(left/256);x<=(left+w)/256;x++)for(let y=Math.floor(top/256);y<=(top+h)/256;y++){jobs.add(load(own,Math.floor(x/d),Math.floor(y/d)));
if(base){const i=new Image();i.src=base.replace("{z}",z).replace("{x}",x).replace("{y}",y);i.style.left=x*256-left+"px";i.style.top=y*256-top+"px";map.prepend(i)}}
const found=await Promise.all(jobs);if(z!==zoom)return;const pen=canvas.getContext("2d");pen.clearRect(0,0,w,h);shown=[];
for(const t of found)for(const f of t.features){const [a,,b]=f.geometry.coordinates[0],x0=across(a[0],z)-left,x1=across(b[0],z)-left,y0=down(b[1],z)-top,y1=down(a[1],z)-top;
const s=f.properties.wealth_score;pen.fillStyle=s===null?"rgba(120,120,120,.15)":`rgba(15,110,86,${.1+.05*s})`;pen.fillRect(x0,y0,x1-x0,y1-y0);pen.strokeStyle="rgba(0,0,0,.25)";pen.strokeRect(x0,y0,x1-x0,y1-y0);shown.push([x0,y0,x1,y1,f.properties])}
svg.replaceChildren(...markers.map(m=>{const c=document.createElementNS("http://www.w3.org/2000/svg","circle");c.setAttribute("cx",across(m.lon,z)-left);c.setAttribute("cy",down(m.lat,z)-top);c.setAttribute("r",m.radius);c.setAttribute("fill",m.color);
c.onclick=e=>{tip.innerHTML=m.popup;tip.hidden=false;tip.style.left=e.clientX+12+"px";tip.style.top=e.clientY+12+"px"};return c}))}
map.onmousemove=e=>{const f=shown.find(s=>s[0]<=e.clientX&&e.clientX<s[2]&&s[1]<=e.clientY&&e.clientY<s[3]);tip.hidden=!f;if(f){tip.textContent=Object.entries(f[4]).map(([k,v])=>`${k}: ${v}`).join(", ");tip.style.left=e.clientX+12+"px";tip.style.top=e.clientY+12+"px"}};
map.onwheel=e=>{zoom=Math.max(coarse,Math.min(finest+4,zoom-Math.sign(e.deltaY)));draw()};let held=null;map.onmousedown=e=>held=[e.clientX,e.clientY];map.onmouseup=e=>{if(held){const d=360/(256*2**zoom);centre=[centre[0]-(e.clientX-held[0])*d,centre[1]+(e.clientY-held[1])*d*Math.cos(centre[1]*Math.PI/180)];held=null;draw()}};onresize=draw;draw()</script>"""


def page(markers: DataFrame, legend: DataFrame, grid: Grid, *, tiles: str, base: str = "") -> DataFrame:
    """One row, ``html``. markers: as many rows as sites were chosen; legend: one row; tiles: the tiles' folder seen from the page; base: a background's address with {z}, {x} and {y}."""
    coarse, finest = levels(grid)
    centre = [round((grid.lon_edges[0] + grid.lon_edges[-1]) / 2, 6), round((grid.lat_edges[0] + grid.lat_edges[-1]) / 2, 6)]
    whole = PAGE.replace("\n", "")  # a row of a text file
    for name, value in (("BASE", json.dumps(base)), ("TILES", json.dumps(tiles)), ("COARSE", str(coarse)), ("FINEST", str(finest)), ("CENTRE", json.dumps(centre))):
        whole = whole.replace(f"__{name}__", value)
    before, between, after = (p for half in whole.split("__LEGEND__") for p in half.split("__MARKERS__"))
    found = markers.agg(F.to_json(F.sort_array(F.collect_list(F.struct("cell_id", "lon", "lat", "color", "radius", "popup")))).alias("_m"))
    return found.crossJoin(F.broadcast(legend)).select(F.concat(F.lit(before), F.col("legend"), F.lit(between), F.col("_m"), F.lit(after)).alias("html"))
