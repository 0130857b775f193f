"""A property-graph store in a SQLite file: it knows the statements that the engine sends, and no others."""

import json
import sqlite3

from kestrel_kg.sources import property_graph as pg


class Session:
    def __init__(self, path):
        self.base = sqlite3.connect(path, timeout=60)
        self.base.execute("CREATE TABLE IF NOT EXISTS node (id TEXT PRIMARY KEY, row TEXT)")
        self.base.execute("CREATE TABLE IF NOT EXISTS edge (a TEXT, kind TEXT, b TEXT, predicate TEXT, key TEXT, row TEXT, PRIMARY KEY (a, kind, b, predicate, key))")
        self.base.execute("CREATE TABLE IF NOT EXISTS asked (low TEXT, high TEXT)")

    def run(self, text, **values):
        if text.startswith("CREATE CONSTRAINT"):
            return []
        if "DETACH DELETE" in text:
            self.base.execute("DELETE FROM node")
            self.base.execute("DELETE FROM edge")
        elif "MERGE (e:Entity" in text:
            for r in values["rows"]:
                old = self.base.execute("SELECT row FROM node WHERE id = ?", [r["id"]]).fetchone()
                self.base.execute("REPLACE INTO node VALUES (?, ?)", [r["id"], json.dumps((json.loads(old[0]) if old else {}) | r)])
        elif "MERGE (s)-[r:" in text:
            kind = text.split("MERGE (s)-[r:`")[1].split("`")[0]
            for r in values["rows"]:
                row = {k: r[k] for k in ("confidence", "source_chunk", "predicate")} | {"metadata_json": r["metadata"]}
                self.base.execute("REPLACE INTO edge SELECT ?, ?, ?, ?, ?, ? WHERE EXISTS (SELECT 1 FROM node WHERE id = ?) AND EXISTS (SELECT 1 FROM node WHERE id = ?)", [r["subject_id"], kind, r["object_id"], r["predicate"], r["relation_key"], json.dumps(row), r["subject_id"], r["object_id"]])
        elif text == pg.SIZE:
            return [{"size": self.base.execute("SELECT count(*) FROM node").fetchone()[0]}]
        elif text == pg.BOUND:
            return [{"id": x} for (x,) in self.base.execute("SELECT id FROM node ORDER BY id LIMIT 1 OFFSET ?", [values["place"]])]
        elif text == pg.READ["nodes"]:
            self.base.execute("INSERT INTO asked VALUES (?, ?)", [values["low"], values["high"]])
            self.base.commit()
            found = self.base.execute("SELECT id, row FROM node WHERE (id >= :low OR :low IS NULL) AND (id < :high OR :high IS NULL)", values)
            return [dict.fromkeys(pg.COLUMNS["nodes"]) | json.loads(r) | {"id": i} for i, r in found]
        elif text == pg.READ["edges"]:
            found = self.base.execute("SELECT a, b, row FROM edge WHERE (a >= :low OR :low IS NULL) AND (a < :high OR :high IS NULL)", values)
            return [dict.fromkeys(pg.COLUMNS["edges"]) | json.loads(r) | {"subject_id": a, "object_id": b} for a, b, r in found]
        else:
            raise ValueError(f"unknown statement: {text}")
        self.base.commit()
        return []

    def close(self):
        self.base.commit()
        self.base.close()


def session(options):
    return Session(options["path"])
