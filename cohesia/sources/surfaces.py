"""Surface scans and exports: ASCII and binary legacy VTK, CARP text triples, frame traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import field_bin, grid_region, ramp
from ..operators import mesh
from ..plans.joins import clip
from ..plans.lineage import cut, width
from ..plans.ordered import row_numbers, running_sums
from .lines import numbered_lines, tokens

G = "graph_id"
HEADERS = "(?i)^(POINTS|POLYGONS|POINT_DATA|CELL_DATA|SCALARS|VECTORS|NORMALS|FIELD|METADATA|DATASET|LINES|VERTICES|TRIANGLE_STRIPS|ASCII|BINARY|#)"


# ---- ASCII polydata ----------------------------------------------------------------------------


def parse_vtk_ascii(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, faces, point_scalars, cell_vectors) from numbered lines of any number of files.

    A header line opens a section that lasts to the next header. Values inside a section are
    located by running token counts, so they may wrap lines freely; polygons take a line each and
    are fanned into triangles.
    """
    text = lines.where(F.trim("line") != "").withColumn("head", F.trim("line").rlike(HEADERS))
    num = running_sums(text, [G], [F.col("line_no")], {"sec": F.col("head").cast("long")})
    num = cut(num.withColumn("sec", F.col("sec") + F.col("head").cast("long")).withColumn("tok", tokens(F.col("line"))))
    heads = num.where("head").select(G, "sec", F.upper(F.col("tok")[0]).alias("kw"), F.get("tok", F.lit(1)).alias("name"))
    side = F.last(F.when(F.col("kw").isin("POINT_DATA", "CELL_DATA"), F.col("kw")), ignorenulls=True).over(Window.partitionBy(G).orderBy("sec"))  # a few headers per file
    heads = cut(heads.withColumn("side", side))
    files = num.select(G).distinct().join(heads.where("kw = 'POINTS'").select(G).distinct(), G, "left_anti").limit(5).collect()
    if files:
        raise ValueError(f"no POINTS section in {[r[0] for r in files]}")
    body = num.where(~F.col("head") & (F.upper(F.col("tok")[0]) != "LOOKUP_TABLE")).select(G, "sec", "line_no", "tok").join(heads, [G, "sec"])

    def stream(part: DataFrame) -> DataFrame:
        run = running_sums(part, [G, "sec"], [F.col("line_no")], {"before": F.size("tok").cast("long")})
        return run.select(G, "sec", "name", "side", "before", F.posexplode("tok").alias("p", "t")).select(G, "sec", "name", "side", (F.col("before") + F.col("p")).alias("i"), F.col("t").cast("double").alias("x"))

    def triples(part: DataFrame, keys: list[str], item: str, out: tuple[str, str, str]) -> DataFrame:
        k = F.col("i") % 3
        return part.groupBy(*keys, F.floor(F.col("i") / 3).alias(item)).agg(*[F.max(F.when(k == n, F.col("x"))).alias(c) for n, c in enumerate(out)])

    nodes = triples(stream(body.where("kw = 'POINTS'")), [G], "node_id", ("x", "y", "z"))
    poly = running_sums(body.where("kw = 'POLYGONS'"), [G], [F.col("line_no")], {"cell_id": F.lit(1).cast("long")})
    n = F.col("tok")[0].cast("int")
    good = F.when(F.size("tok") == n + 1, n).otherwise(F.raise_error(F.lit("a polygon line holds a wrong number of ids")).cast("int"))
    poly = poly.withColumn("n", good).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 2)))
    at = lambda i: F.element_at("tok", i + 1).cast("long")
    faces = poly.select(G, "cell_id", "k", at(F.lit(1)).alias("a"), at(F.col("k") + 1).alias("b"), at(F.col("k") + 2).alias("c"))
    scal = stream(body.where("kw = 'SCALARS' and side = 'POINT_DATA'")).select(G, F.col("i").alias("node_id"), "name", F.col("x").alias("value"))
    vec = triples(stream(body.where("kw = 'VECTORS' and side = 'CELL_DATA'")), [G, "name"], "cell_id", ("vx", "vy", "vz"))
    return nodes, faces, scal, vec


def read_vtk_ascii(spark: SparkSession, path: str, stem: Column | None = None):
    return parse_vtk_ascii(numbered_lines(spark, path, stem))


# Field names of the intensity surfaces; fixed values.
CHART_NAMES = ("UAC1", "UAC2")
INTENSITY_NAME = "IIR"
FIBRE_NAMES = ("fiber_endo", "fiber_epi")


def intensity_surface(parsed) -> tuple[DataFrame, DataFrame]:
    """Scaled points, clipped chart, ramped intensity, vertex fibres and a 3x3 region grid for every file."""
    nodes, faces, scal, vec = parsed
    nodes = nodes.select(G, "node_id", *[(F.col(c) * 1e-3).alias(c) for c in "xyz"])
    wide = scal.groupBy(G, "node_id").pivot("name", [*CHART_NAMES, INTENSITY_NAME]).agg(F.first("value"))
    nodes = nodes.join(wide, [G, "node_id"], "left").select(
        G, "node_id", "x", "y", "z", clip(F.coalesce(CHART_NAMES[0], F.lit(0.0)), 0.0, 1.0).alias("u"), clip(F.coalesce(CHART_NAMES[1], F.lit(0.0)), 0.0, 1.0).alias("v"),
        ramp(F.coalesce(INTENSITY_NAME, F.lit(1.0))).alias("fibrosis"),
    )
    best = vec.where(F.col("name").isin(*FIBRE_NAMES)).withColumn("o", F.when(F.col("name") == FIBRE_NAMES[0], 0).otherwise(1))
    best = best.groupBy(G, "cell_id").agg(F.min_by(F.struct("vx", "vy", "vz"), "o").alias("v"))
    # A file without either vector keeps the +x axis.
    f = faces.join(best, [G, "cell_id"], "left").select(G, (F.col("cell_id") * 64 + F.col("k")).alias("face_id"), "a", "b", "c", *[F.coalesce(F.col(f"v.v{c}"), F.lit(d)).alias(f"v{c}") for c, d in zip("xyz", (1.0, 0.0, 0.0))])
    fib = mesh.cell_vector_to_vertex(f, nodes)
    nodes = nodes.join(fib, [G, "node_id"]).withColumn("region", grid_region(F.col("u"), F.col("v"))).withColumn("shape_family", F.col(G))
    return nodes, f.select(G, "face_id", "a", "b", "c")


def load_intensity_surface(spark: SparkSession, path: str, stem: Column | None = None) -> tuple[DataFrame, DataFrame]:
    return intensity_surface(read_vtk_ascii(spark, path, stem))


# ---- binary unstructured grid --------------------------------------------------------------------

_ROWS = "graph_id string, kind string, name string, idx long, a double, b double, c double"
_CHUNK = 65_536


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, content) per file; a binary mesh is decoded where its bytes are read."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _decode_grid(content: bytes):
    """Yield (kind, name, rows x 3 array) blocks of a big-endian legacy unstructured grid."""
    pos, side = 0, None

    def line():
        nonlocal pos
        end = content.index(b"\n", pos)
        out = content[pos:end].decode("ascii", "replace").strip()
        pos = end + 1
        return out

    def take(dtype, n):
        nonlocal pos
        out = np.frombuffer(content, dtype=dtype, count=n, offset=pos)
        pos += out.nbytes
        return out

    kinds = {"int": ">i4", "float": ">f4", "double": ">f8"}
    while pos < len(content) and b"\n" in content[pos:]:
        w = line().split()
        if not w:
            continue
        if w[0] == "POINTS":
            yield "point", "", take(kinds[w[2]], 3 * int(w[1])).reshape(-1, 3)
        elif w[0] == "CELLS":
            cells = take(">i4", int(w[2])).reshape(-1, 4)
            yield "cell", "", cells[:, 1:]
        elif w[0] == "CELL_TYPES":
            take(">i4", int(w[1]))
        elif w[0] in ("POINT_DATA", "CELL_DATA"):
            side, n = w[0], int(w[1])
        elif w[0] == "SCALARS":
            line()
            v = take(kinds[w[2]], n).astype(float)
            yield f"{side}_scalar", w[1], np.column_stack([v, np.zeros((n, 2))])
        elif w[0] == "VECTORS":
            yield f"{side}_vector", w[1], take(kinds[w[2]], 3 * n).reshape(-1, 3)


def _decode_batches(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            for kind, name, arr in _decode_grid(bytes(content)):
                for lo in range(0, len(arr), _CHUNK):
                    part = arr[lo : lo + _CHUNK].astype(float)
                    yield pd.DataFrame({G: stem, "kind": kind, "name": name, "idx": np.arange(lo, lo + len(part)), "a": part[:, 0], "b": part[:, 1], "c": part[:, 2]})


def parse_vtk_binary(files: DataFrame, tag: str = "elemTag", vector: str = "fiber") -> tuple[DataFrame, DataFrame]:
    """(nodes, faces with tag and vector) from (path, content) rows; a file is the unit of decoding."""
    rows = cut(files.select("path", "content").mapInPandas(_decode_batches, _ROWS))
    nodes = rows.where("kind = 'point'").select(G, F.col("idx").alias("node_id"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    cells = rows.where("kind = 'cell'").select(G, F.col("idx").alias("face_id"), *[F.col(c).cast("long").alias(c) for c in "abc"])
    tags = rows.where((F.col("kind") == "CELL_DATA_scalar") & (F.col("name") == tag)).select(G, F.col("idx").alias("face_id"), F.col("a").cast("int").alias("tag"))
    vec = rows.where((F.col("kind") == "CELL_DATA_vector") & (F.col("name") == vector)).select(G, F.col("idx").alias("face_id"), F.col("a").alias("vx"), F.col("b").alias("vy"), F.col("c").alias("vz"))
    return nodes, cells.join(tags, [G, "face_id"], "left").join(vec, [G, "face_id"], "left")


# Tag meaning of the tagged surfaces (value per tag, tag removed by default); fixed values.
TAG_VALUES = {111: 0.0, 115: 1.0, 164: 0.5, 199: 1.0}
DEAD_TAGS = (164,)


def tagged_surface(nodes: DataFrame, faces: DataFrame, drop=DEAD_TAGS, tag_values=TAG_VALUES, dead=DEAD_TAGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, faces, provenance): scaled points, dropped tags, vertex values and fibres, principal chart, regions."""
    nodes = nodes.select(G, "node_id", *[(F.col(c) * 1e-3).alias(c) for c in "xyz"])
    faces = cut(faces)
    mesh.assert_tags(faces, list(dead), list(drop))
    share = mesh.tag_fractions(faces).groupBy(G).agg(F.map_from_entries(F.collect_list(F.struct(F.col("tag").cast("string"), "share"))).alias("tag_shares"))
    nodes, kept, dropped = mesh.drop_faces(nodes, faces, list(drop))
    nodes, kept = cut(nodes), cut(kept)
    fib = mesh.cell_scalar_to_vertex(kept, tag_values).withColumnRenamed("value", "fibrosis")
    nodes = nodes.join(fib, [G, "node_id"]).join(mesh.cell_vector_to_vertex(kept, nodes), [G, "node_id"])
    spread = mesh.vector_spread(nodes)
    nodes = mesh.grid_regions(mesh.pca_chart(nodes)).withColumn("shape_family", F.concat(F.lit("uw_"), F.col(G)))
    meta = share.join(dropped, G).join(spread, G)
    return nodes, kept, meta


def load_tagged_surface(spark: SparkSession, path: str, drop=DEAD_TAGS):
    return tagged_surface(*parse_vtk_binary(binary_files(spark, path)), drop=drop)


# ---- CARP text triples ---------------------------------------------------------------------------


def _carp_file(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Numbered token lines of <root>/<stem>.<kind> files, or of <root>/<kind>/graph_id=<id>/ part files."""
    try:
        lines = numbered_lines(spark, f"{root}/*.{kind}")
    except AnalysisException:
        lines = numbered_lines(spark, f"{root}/{kind}", F.regexp_extract("_path", r"graph_id=([^/]+)/", 1))
    return lines.withColumn("t", tokens(F.col("line")))


def _counted(lines: DataFrame) -> DataFrame:
    """The lines that the count in each file's first line promises, without blank ones."""
    size = lines.where("line_no = 0").select(G, F.col("t")[0].try_cast("long").alias("_n"))  # a row for each file
    return lines.join(size, G).where((F.col("line_no") >= 1) & (F.col("line_no") <= F.col("_n")) & (F.trim("line") != ""))


def read_carp(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, faces) of every triple under root, as files side by side or as written by `write_carp`.

    Points keep their place, faces are numbered densely over the `Tr` elements; fibres are read by `read_carp_fibres`.
    """
    pts = _counted(_carp_file(spark, root, "pts"))
    nodes = pts.select(G, (F.col("line_no") - 1).alias("node_id"), *[F.col("t")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    el = _counted(_carp_file(spark, root, "elem")).where(F.col("t")[0] == "Tr")
    el = row_numbers(el, [G], [F.col("line_no")], "face_id")
    faces = el.select(G, "face_id", *[F.col("t")[i + 1].cast("long").alias(c) for i, c in enumerate("abc")], F.get("t", F.lit(4)).cast("int").alias("tag"))
    return nodes, faces


def read_carp_fibres(spark: SparkSession, root: str) -> DataFrame:
    """Fibre of each element: lines of three numbers. A first line of fewer is a header."""
    lon = _carp_file(spark, root, "lon").where((F.size("t") >= 3) & F.expr("try_cast(t[0] AS double)").isNotNull())
    lon = row_numbers(lon, [G], [F.col("line_no")], "face_id")
    return lon.select(G, "face_id", *[F.col("t")[i].cast("double").alias(f"f{c}") for i, c in enumerate("xyz")])


def write_ordered(lines: DataFrame, path: str) -> None:
    """lines(graph_id, ord, line) as text under path/graph_id=<id>/, in order across numbered part files.

    Ranges of (graph, line) are written side by side, so a large graph spans several parts.
    """
    out = lines.repartitionByRange(width(lines.sparkSession), G, "ord").sortWithinPartitions(G, "ord")
    out.select(G, "line").write.partitionBy(G).mode("overwrite").text(path)


def carp_lines(nodes: DataFrame, faces: DataFrame, bins: int | None = None) -> dict[str, DataFrame]:
    """Ordered lines of the three files. Tag = region of the first corner, or the bin of the mean corner fibrosis."""
    digits = "%.9g"
    count = lambda df: df.groupBy(G).agg(F.lit(-1).cast("long").alias("ord"), F.count(F.lit(1)).cast("string").alias("line"))
    num = lambda c: F.format_string(digits, c)
    pts = nodes.select(G, F.col("node_id").alias("ord"), F.concat_ws(" ", *[num(F.col(c)) for c in "xyz"]).alias("line"))
    f = faces
    for k in "abc":
        cols = [F.col(c).alias(f"{c}_{k}") for c in ("region", "fibrosis", "fx", "fy", "fz")]
        f = f.join(nodes.select(G, F.col("node_id").alias(k), *cols), [G, k])
    mean = lambda c: (F.col(f"{c}_a") + F.col(f"{c}_b") + F.col(f"{c}_c")) / 3
    tag = F.col("region_a") if bins is None else field_bin(clip(mean("fibrosis"), 0.0, 1.0), bins)
    elem = f.select(G, F.col("face_id").alias("ord"), F.concat_ws(" ", F.lit("Tr"), *[F.col(c).cast("string") for c in "abc"], tag.cast("string")).alias("line"))
    from ..functions.fields import unit3

    fib = unit3(mean("fx"), mean("fy"), mean("fz"), floor=0.0)
    lon = f.select(G, F.col("face_id").alias("ord"), F.concat_ws(" ", *[num(v) for v in fib]).alias("line"))
    one = faces.select(G).distinct().select(G, F.lit(-1).cast("long").alias("ord"), F.lit("1").alias("line"))
    return {"pts": count(nodes).unionByName(pts), "elem": count(faces).unionByName(elem), "lon": one.unionByName(lon)}


def write_carp(nodes: DataFrame, faces: DataFrame, root: str, bins: int | None = None) -> None:
    for name, lines in carp_lines(nodes, faces, bins).items():
        write_ordered(lines, f"{root}/{name}")


# ---- frame traces --------------------------------------------------------------------------------


def _decode_traces(batches):
    """Frames of many files in batches of about _CHUNK rows; a file may be short or of many chunks."""

    def table(parts):
        stems, node, frame, v = zip(*parts)
        names = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(v)), [len(x) for x in v])), pa.array(stems, pa.string())).cast(pa.string())
        return pa.record_batch([names, *map(pa.array, (np.concatenate(node), np.concatenate(frame), np.concatenate(v).astype(float)))], names=["run_id", "node_id", "frame", "v"])

    for b in batches:
        parts, rows = [], 0
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            raw = content.as_buffer()
            head = dict(w.split(":", 1) for w in raw[:1024].to_pybytes().decode("ascii", "ignore").replace("\x00", " ").split() if ":" in w)
            n, frames = int(head["x"]), int(head["t"])
            v = np.frombuffer(raw, dtype="<f4", offset=1024, count=n * frames)
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            for lo in range(0, v.size, _CHUNK):
                i = np.arange(lo, min(lo + _CHUNK, v.size))
                parts.append((stem, i % n, i // n, v[i]))
                rows += len(i)
                if rows >= _CHUNK:
                    yield table(parts)
                    parts, rows = [], 0
        if parts:
            yield table(parts)


def parse_igb(files: DataFrame) -> DataFrame:
    """frames(run_id, node_id, frame, v) from (path, content) rows: 1024-byte header, float32 little-endian frames."""
    return files.select("path", "content").mapInArrow(_decode_traces, "run_id string, node_id long, frame long, v double")


def read_igb(spark: SparkSession, path: str) -> DataFrame:
    return parse_igb(binary_files(spark, path))
