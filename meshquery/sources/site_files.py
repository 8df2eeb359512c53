"""Binary site and observation files, robots.txt, sitemaps and feeds as DataFrames. Files are read by Spark (binaryFile), so
any store Spark reaches will do; parsing is per file in Arrow batches."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The site file's layout, little-endian; a CRC-32 of all before it ends the file.
CTX_MAGIC, CTX_VERSION, WIDTH = 0x43545800, 1, 128
HEAD, COUNTS = struct.Struct("<IHH"), struct.Struct("<QIIHH")
NODE = np.dtype([("page_type", "u1"), ("confidence", "u1"), ("freshness", "u1"), ("flags", "u1"), ("content_hash", "<u4"), ("rendered_at", "<u4"), ("http_status", "<u2"), ("depth", "<u2"), ("inbound", "<u2"), ("outbound", "<u2"), ("norm", "<f4"), ("reserved", "<u4")])
EDGE = np.dtype([("dst", "<u4"), ("edge_type", "u1"), ("weight", "u1"), ("flags", "u1"), ("reserved", "u1")])
ACTION = np.dtype([("opcode", "<u2"), ("target", "<i4"), ("cost", "u1"), ("risk", "u1")])
# The observation file's header, 64 bytes, before a JSON payload.
AVIS_MAGIC, AVIS_HEAD = 0x41564953, struct.Struct("<IHHQIIQQQ16x")


class BadFile(ValueError):
    pass


def ctx_bytes(site: dict) -> bytes:
    """A site file of {domain, mapped_at, flags, urls, nodes, features, edges (src, dst, type, weight, flags), actions
    (node, opcode, target, cost, risk), clusters, centroids}."""
    n = len(site["urls"])

    def index(owners: list[int]) -> bytes:
        return np.concatenate([[0], np.cumsum(np.bincount(np.asarray(owners, dtype=np.int64), minlength=n))]).astype("<u4").tobytes() if n or owners else np.zeros(1, "<u4").tobytes()

    edges, actions = sorted(site.get("edges", [])), sorted(site.get("actions", []))
    centroids = np.asarray(site.get("centroids", []), dtype="<f4").reshape(-1, WIDTH)
    name = site["domain"].encode()
    out = [HEAD.pack(site.get("magic", CTX_MAGIC), CTX_VERSION, len(name)), name, COUNTS.pack(site.get("mapped_at", 0), n, len(edges), len(centroids), site.get("flags", 0))]
    rows = site["nodes"]
    out.append((rows if isinstance(rows, np.ndarray) else np.array([(*row, 0) for row in rows], dtype=NODE)).tobytes())
    out += [np.array([(d, t, w, f, 0) for _, d, t, w, f in edges], dtype=EDGE).tobytes(), index([e[0] for e in edges])]
    out.append(np.asarray(site["features"], dtype="<f4").reshape(n, WIDTH).tobytes())
    out += [struct.pack("<I", len(actions)), np.array([a[1:] for a in actions], dtype=ACTION).tobytes(), index([a[0] for a in actions])]
    out += [np.asarray(site.get("clusters", [0] * n), dtype="<u2").tobytes(), centroids.tobytes()]
    urls = [u.encode() + b"\0" for u in site["urls"]]
    out += [struct.pack("<I", sum(map(len, urls))), b"".join(urls), np.concatenate([[0], np.cumsum([len(u) for u in urls])[:-1]]).astype("<u4").tobytes() if urls else b""]
    check = 0
    for piece in out:
        check = zlib.crc32(piece, check)
    return b"".join([*out, struct.pack("<I", check)])


def ctx_site(data: bytes) -> dict:
    """The parts of a site file; checks the sum, the magic number and every length."""
    if len(data) < HEAD.size + COUNTS.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise BadFile("checksum mismatch")
    magic, version, size = HEAD.unpack_from(data)
    if magic != CTX_MAGIC or version != CTX_VERSION:
        raise BadFile(f"unknown magic {magic:#x} or version {version}")
    at = HEAD.size + size
    domain = data[HEAD.size : at].decode()
    mapped_at, n, m, k, flags = COUNTS.unpack_from(data, at)
    at += COUNTS.size

    def take(kind, count: int) -> np.ndarray:
        nonlocal at
        kind = np.dtype(kind)
        if at + kind.itemsize * count > len(data) - 4:
            raise BadFile("truncated")
        at += kind.itemsize * count
        return np.frombuffer(data, kind, count, at - kind.itemsize * count)

    nodes, edges, edge_index = take(NODE, n), take(EDGE, m), take("<u4", n + 1)
    features = take("<f4", n * WIDTH).reshape(n, WIDTH)
    actions = take(ACTION, int(take("<u4", 1)[0]))
    action_index, clusters, centroids = take("<u4", n + 1), take("<u2", n), take("<f4", k * WIDTH).reshape(k, WIDTH)
    text = take("u1", int(take("<u4", 1)[0])).tobytes()
    urls = [text[o : text.index(b"\0", o)].decode() for o in take("<u4", n)]
    return {
        "domain": domain, "mapped_at": mapped_at, "flags": flags, "nodes": nodes, "features": features, "urls": urls, "clusters": clusters, "centroids": centroids, "edges": edges,
        "edge_src": np.repeat(np.arange(n), np.diff(edge_index.astype(np.int64))), "actions": actions, "action_src": np.repeat(np.arange(n), np.diff(action_index.astype(np.int64))),
    }


#: So many rows of a part are in memory at once.
SLICE = 10_000


def site_slices(f, part: str, size: int) -> Iterator[pd.DataFrame]:
    """``site_rows`` of a site file of ``size`` bytes, a slice at a time; ``f`` can be read anywhere. The file is read once for its sum, before any row is
    given, and once for its rows: of a site 4 bytes a page are in memory, and a slice."""

    def at(place: int, length: int) -> bytes:
        f.seek(place)
        return f.read(length)

    check, left = 0, size - 4
    f.seek(0)
    while left > 0 and (block := f.read(min(left, 1 << 20))):
        check, left = zlib.crc32(block, check), left - len(block)
    if size < HEAD.size + COUNTS.size + 4 or left or check != struct.unpack("<I", at(size - 4, 4))[0]:
        raise BadFile("checksum mismatch")
    magic, version, length = HEAD.unpack(at(0, HEAD.size))
    if magic != CTX_MAGIC or version != CTX_VERSION:
        raise BadFile(f"unknown magic {magic:#x} or version {version}")
    place = HEAD.size + length
    domain = at(HEAD.size, length).decode()
    _, n, m, k, _ = COUNTS.unpack(at(place, COUNTS.size))
    place += COUNTS.size

    def part_of(kind, count: int):
        """Reads rows i to j of the next part."""
        nonlocal place
        kind, start = np.dtype(kind), place
        place += kind.itemsize * count
        if place > size - 4:
            raise BadFile("truncated")
        return lambda i=0, j=count: np.frombuffer(at(start + i * kind.itemsize, (min(j, count) - i) * kind.itemsize), kind)

    def owners(index: np.ndarray, count: int, i: int, j: int) -> np.ndarray:
        if index[0] != 0 or index[-1] != count or (index[1:] < index[:-1]).any():
            raise BadFile("wrong index")
        return np.searchsorted(index, np.arange(i, min(j, count)), side="right") - 1

    nodes, edges, edge_index, features = part_of(NODE, n), part_of(EDGE, m), part_of("<u4", n + 1), part_of(np.dtype(("<f4", WIDTH)), n)
    acts = int(part_of("<u4", 1)()[0])
    actions, action_index, clusters, _ = part_of(ACTION, acts), part_of("<u4", n + 1), part_of("<u2", n), part_of(np.dtype(("<f4", WIDTH)), k)
    chars = int(part_of("<u4", 1)()[0])
    text, offsets = part_of("u1", chars), part_of("<u4", n)

    def urls(i: int, j: int) -> list[str]:
        starts = offsets(i, j).astype(np.int64)
        low, high = int(starts.min()), int(starts.max())
        if high >= chars:
            raise BadFile("truncated")
        found = text(low, high + 4096).tobytes()
        while found.find(b"\0", high - low) < 0:
            if low + len(found) >= chars:
                raise BadFile("truncated")
            found += text(low + len(found), low + 2 * len(found) + 4096).tobytes()
        return [found[o : found.index(b"\0", o)].decode() for o in (starts - low).tolist()]

    if part == "nodes":
        for i in range(0, n, SLICE):
            own = site_rows({"domain": domain, "nodes": nodes(i, i + SLICE), "urls": urls(i, i + SLICE), "features": features(i, i + SLICE).reshape(-1, WIDTH), "clusters": clusters(i, i + SLICE)}, part)
            yield own.assign(node_id=own.node_id + i)
        return
    index, count = (edge_index(), m) if part == "edges" else (action_index(), acts)
    for i in range(0, count, 10 * SLICE):  # narrow rows
        own, j = owners(index, count, i, i + 10 * SLICE), i + 10 * SLICE
        yield site_rows({"domain": domain, "edges": edges(i, j), "edge_src": own} if part == "edges" else {"domain": domain, "actions": actions(i, j), "action_src": own}, part)


def read_ctx(spark: SparkSession, path: str, part: str = "nodes") -> DataFrame:
    """``nodes``, ``edges`` or ``actions`` of all site files under a path."""
    return ctx_rows(spark.read.format("binaryFile").load(path), part)


def ctx_files(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(domain, content): one site file per domain, of nodes (domain, url, page_type, confidence, flags, features, ...) numbered by
    node_id from 0, and of edges (domain, src, dst, edge_type, weight, flags) between node_ids. A file is one site's, and so one task's."""
    slim = nodes.select("domain", "node_id", "url", "page_type", "confidence", "flags", "features")
    none = slim.select("domain", F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0).alias("edge_type"), F.lit(0).alias("weight"), "flags").limit(0)
    links = none if edges is None else edges.select("domain", "src", "dst", "edge_type", "weight", "flags")

    def one(key: tuple, pages: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        pages = pages.sort_values("node_id", kind="stable")
        number = {n: i for i, n in enumerate(pages.node_id)}
        rows = np.zeros(len(pages), dtype=NODE)
        for name in ("page_type", "confidence", "flags"):
            rows[name] = pages[name]
        rows["norm"] = [np.linalg.norm(f) for f in pages.features]
        kept = [(number[e.src], number[e.dst], e.edge_type, e.weight, e.flags) for e in between.itertuples() if e.src in number and e.dst in number]
        site = {"domain": key[0], "nodes": rows, "edges": sorted(kept), "features": np.stack(pages.features) if len(pages) else np.zeros((0, WIDTH)), "urls": pages.url.tolist(), "actions": []}
        return pd.DataFrame({"domain": [key[0]], "content": [ctx_bytes(site)]})

    return slim.groupBy("domain").cogroup(links.groupBy("domain")).applyInPandas(one, "domain string, content binary")


# Columns of the parts of a site file.
PARTS = {
    "nodes": "domain string, node_id int, url string, page_type int, confidence int, freshness int, flags int, content_hash bigint, rendered_at bigint, http_status int, depth int, inbound_count int, outbound_count int, feature_norm float, cluster int, features array<float>",
    "edges": "domain string, src int, dst int, edge_type int, weight int, flags int",
    "actions": "domain string, node_id int, category int, action int, target_node int, cost_hint int, risk int",
}


def site_rows(s: dict, part: str, own: slice = slice(None)) -> pd.DataFrame:
    """A part of a site, as PARTS has it; of its nodes those in ``own``."""
    if part == "nodes":
        r = s["nodes"][own]
        return pd.DataFrame({"domain": s["domain"], "node_id": np.arange(len(s["nodes"]))[own], "url": s["urls"][own], "page_type": r["page_type"], "confidence": r["confidence"], "freshness": r["freshness"], "flags": r["flags"], "content_hash": r["content_hash"].astype(np.int64), "rendered_at": r["rendered_at"].astype(np.int64), "http_status": r["http_status"], "depth": r["depth"], "inbound_count": r["inbound"], "outbound_count": r["outbound"], "feature_norm": r["norm"], "cluster": s["clusters"][own], "features": list(s["features"][own])})
    if part == "edges":
        r = s["edges"]
        return pd.DataFrame({"domain": s["domain"], "src": s["edge_src"], "dst": r["dst"].astype(np.int64), "edge_type": r["edge_type"], "weight": r["weight"], "flags": r["flags"]})
    r = s["actions"]
    return pd.DataFrame({"domain": s["domain"], "node_id": s["action_src"], "category": r["opcode"] >> 8, "action": r["opcode"] & 255, "target_node": r["target"], "cost_hint": r["cost"], "risk": r["risk"]})


def ctx_rows(files: DataFrame, part: str = "nodes") -> DataFrame:
    """``nodes``, ``edges`` or ``actions`` of site files in a column ``content``."""

    def run(batches):
        for pdf in batches:
            for data in pdf.content:
                site = ctx_site(bytes(data))
                for at in range(0, len(site["nodes"]) if part == "nodes" else 1, 10_000):  # a site's features as Python objects are many times its file
                    yield site_rows(site, part, slice(at, at + 10_000))

    return files.select("content").mapInPandas(run, PARTS[part])


def avis_bytes(observations: list[dict], width: int, sessions: int, created: int = 0, updated: int = 0) -> bytes:
    payload = json.dumps({"observations": observations, "embedding_dim": width, "next_id": 1 + max([o["id"] for o in observations], default=0), "session_count": sessions, "created_at": created, "updated_at": updated}).encode()
    return AVIS_HEAD.pack(AVIS_MAGIC, 1, 0, len(observations), width, sessions, created, updated, len(payload)) + payload


def avis_rows(data: bytes) -> pd.DataFrame:
    """The observations of one file."""
    magic, version, _, count, *_, size = AVIS_HEAD.unpack_from(data)
    if magic != AVIS_MAGIC or len(data) < AVIS_HEAD.size + size:
        raise BadFile("not an observation file, or cut off")
    rows = json.loads(data[AVIS_HEAD.size : AVIS_HEAD.size + size])["observations"]
    meta = [o.get("metadata") or o.get("meta") or {} for o in rows]
    return pd.DataFrame({"id": [o["id"] for o in rows], "ts": pd.to_datetime([o["timestamp"] for o in rows], unit="s"), "session_id": [o["session_id"] for o in rows], "embedding": [o["embedding"] for o in rows], "labels": [m.get("labels", []) for m in meta], "description": [m.get("description") for m in meta], "memory_link": pd.array([o.get("memory_link") for o in rows], dtype="Int64")})


def read_avis(spark: SparkSession, path: str) -> DataFrame:
    """(id, ts, session_id, embedding, labels, description, memory_link) of all observation files under a path."""

    def run(batches):
        for pdf in batches:
            for data in pdf.content:
                yield avis_rows(bytes(data))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id bigint, ts timestamp, session_id int, embedding array<float>, labels array<string>, description string, memory_link bigint")


def robots(text: str | None, agent: str = "*") -> dict:
    """The rules of the group for ``agent`` (else ``*``): {rules: [(kind, pattern)], delay, sitemaps}."""
    groups: dict[str, list] = {}
    current, open_group, delays, maps = [], False, {}, []
    for line in (text or "").splitlines():
        name, _, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            current = [*current, value.lower()] if open_group else [value.lower()]
            open_group = True
            for a in current:
                groups.setdefault(a, [])
        elif name in ("allow", "disallow"):
            open_group = False
            for a in current:
                if value:
                    groups[a].append((name, value))
        elif name == "crawl-delay":
            open_group = False
            for a in current:
                try:
                    delays[a] = float(value)
                except ValueError:
                    pass
        elif name == "sitemap" and value:
            maps.append(value)
    own = next((a for a in groups if a != "*" and a in agent.lower()), "*")
    return {"rules": groups.get(own, []), "delay": delays.get(own), "sitemaps": maps}


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, kind, pattern) from (domain, text)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(d, k, p) for d, t in zip(pdf.domain, pdf.text, strict=True) for k, p in robots(t, agent)["rules"]], columns=["domain", "kind", "pattern"])

    return files.select("domain", "text").mapInPandas(run, "domain string, kind string, pattern string")


def robots_told(files: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, delay double, sitemaps array<string>) from (domain, text): seconds between two requests, null if not told, and the sitemaps."""

    def run(batches):
        for pdf in batches:
            told = [robots(t, agent) for t in pdf.text]
            yield pd.DataFrame({"domain": pdf.domain, "delay": pd.array([r["delay"] for r in told], dtype="Float64"), "sitemaps": [r["sitemaps"] for r in told]})

    return files.select("domain", "text").mapInPandas(run, "domain string, delay double, sitemaps array<string>")


def _tree(text: str | None):
    try:
        return ElementTree.fromstring((text or "").strip())
    except ElementTree.ParseError:
        return None


def _bare(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _child(node, *names: str) -> str | None:
    return next(((c.text or c.get("href") or "").strip() or None for c in node if _bare(c.tag) in names), None)


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(domain, url, lastmod, priority) from (domain, text) sitemaps; entries of an index have priority 1.0."""

    def run(batches):
        for pdf in batches:
            rows = []
            for d, t in zip(pdf.domain, pdf.text, strict=True):
                for e in _tree(t) if _tree(t) is not None else ():
                    url, priority = _child(e, "loc"), _child(e, "priority")
                    if url:
                        try:
                            share = 1.0 if _bare(e.tag) == "sitemap" else float(priority or 0.5)
                        except ValueError:
                            share = 0.5
                        rows.append((d, url, _child(e, "lastmod"), share))
            yield pd.DataFrame(rows, columns=["domain", "url", "lastmod", "priority"])

    out = files.select("domain", "text").mapInPandas(run, "domain string, url string, lastmod string, priority double")
    return out.withColumn("lastmod", F.coalesce(F.try_to_timestamp("lastmod"), F.try_to_timestamp("lastmod", F.lit("yyyy-MM-dd"))))


def feed_entries(files: DataFrame) -> DataFrame:
    """(domain, title, url, published, summary) of RSS 2.0 and Atom feeds from (domain, text)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for d, t in zip(pdf.domain, pdf.text, strict=True):
                tree = _tree(t)
                for e in tree.iter() if tree is not None else ():
                    if _bare(e.tag) in ("item", "entry"):
                        rows.append((d, _child(e, "title"), _child(e, "link", "guid", "id"), _child(e, "pubdate", "published", "updated"), _child(e, "description", "summary", "content")))
            yield pd.DataFrame(rows, columns=["domain", "title", "url", "published", "summary"])

    return files.select("domain", "text").mapInPandas(run, "domain string, title string, url string, published string, summary string")


def feed_links(pages: DataFrame) -> DataFrame:
    """(url, feed) announced in page heads."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<link\b[^>]*type=[\"']application/(?:rss|atom)\+xml[\"'][^>]*>"), F.lit(0))
    return pages.select("url", F.explode(tags).alias("tag")).select("url", F.regexp_extract("tag", r"(?i)href=[\"']([^\"']+)", 1).alias("feed")).where("feed <> ''")
