"""The engine's calls: named, with checked input, an owner's gate for those that write, and a receipt each."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import STATUSES, Profile
from .functions import contacts, dates, strings
from .operators import dedupe, digest, series
from .sources import candidates

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list}


def validate(value: dict, schema: dict) -> tuple[dict, list[str]]:
    """(value with defaults, problems) against the subset type, enum, minimum, maximum, maxLength, items, required, default; no other keys."""
    props, out, problems = schema.get("properties", {}), dict(value), []
    problems += [f"{k}: unknown" for k in value if k not in props]
    for k, p in props.items():
        if k not in out:
            if "default" in p:
                out[k] = p["default"]
            elif k in schema.get("required", ()):
                problems.append(f"{k}: required")
            continue
        v = out[k]
        if not isinstance(v, KINDS[p["type"]]) or (p["type"] in ("integer", "number") and isinstance(v, bool)):
            problems.append(f"{k}: not a {p['type']}")
            continue
        if "enum" in p and v not in p["enum"]:
            problems.append(f"{k}: not one of {p['enum']}")
        if v is not None and p["type"] in ("integer", "number") and not p.get("minimum", v) <= v <= p.get("maximum", v):
            problems.append(f"{k}: out of range")
        if p["type"] == "string" and len(v) > p.get("maxLength", len(v)):
            problems.append(f"{k}: too long")
        if p["type"] == "array" and not all(isinstance(x, KINDS[p["items"]["type"]]) for x in v):
            problems.append(f"{k}: wrong items")
    return out, problems


def _text(limit: int = 200, **more: Any) -> dict:
    return {"type": "string", "maxLength": limit, **more}


@dataclass
class Engine:
    """Tables by name (leads, prices, orders, items) and what is called on them."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    profile: Profile
    receipts: list[dict] = field(default_factory=list)

    def call(self, name: str, role: str = "reader", **values: Any) -> dict:
        """{'ok', 'result' or 'error'}; never raises. Results are DataFrames, small dicts or texts."""
        tool = TOOLS.get(name)
        if not tool:
            out = {"ok": False, "error": f"no tool {name}"}
        else:
            given, problems = validate(values, tool.schema)
            if problems:
                out = {"ok": False, "error": "; ".join(problems)}
            elif tool.owner_only and role not in ("owner", "system"):
                out = {"ok": False, "error": "only the owner may"}
            else:
                try:
                    out = {"ok": True, "result": tool.run(self, **given)}
                except Exception as e:  # a call reports, it does not end the caller
                    out = {"ok": False, "error": str(e)}
        short = hashlib.sha256(json.dumps([name, values], sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.receipts.append({"seq": len(self.receipts), "type": f"tool.{name}", "role": role, "input": short, "ok": out["ok"]})
        return out


@dataclass(frozen=True)
class Tool:
    run: Callable
    schema: dict
    owner_only: bool = False


def _search(e: Engine, query: str, status: str, city: str, kind: str, segment: str, min_score: int, limit: int) -> dict:
    rows = e.tables["leads"]
    for column, value in (("status", status), ("kind", kind), ("segment", segment)):
        if value:
            rows = rows.where(F.col(column) == value)
    if city:
        rows = rows.where(strings.city_key(F.col("city")) == strings.city_key(F.lit(city)))
    rows = rows.where(F.col("score") >= min_score)
    hits = rows.where(strings.matches_query(F.col("name"), F.col("requirement") if "requirement" in rows.columns else F.lit(None).cast("string"), F.col("phone"), query))
    top = hits.orderBy(F.desc("score"), "id").limit(limit)
    return {"leads": top, "matched": hits.count(), "total": e.tables["leads"].count()}


def _get(e: Engine, id: str) -> dict:
    found = e.tables["leads"].where(F.col("id").cast("string") == id).limit(1).collect()
    return {"found": bool(found), "lead": found[0].asDict() if found else None}


def _set_status(e: Engine, id: str, status: str, note: str) -> dict:
    leads = e.tables["leads"]
    hit = F.col("id").cast("string") == id
    if not leads.where(hit).limit(1).count():
        return {"found": False}
    noted = F.when(hit & F.lit(bool(note)), F.concat_ws("\n", "notes", F.lit(note))).otherwise(F.col("notes")) if "notes" in leads.columns else None
    out = leads.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
    e.tables["leads"] = out.withColumn("notes", noted) if noted is not None else out
    return {"found": True, "status": status}


def _prices(e: Engine, items: list, state: str, days: int, end: str) -> dict:
    last = F.lit(end).cast("date")
    rows = e.tables["prices"].where(F.col("date").between(F.date_sub(last, days - 1), last))
    rows = rows.where(F.col("commodity").isin(*items)) if items else rows
    rows = rows.where(F.col("state") == state) if state else rows
    without = e.tables["items"].join(rows.select("commodity"), "commodity", "left_anti")
    return {"rows": rows.orderBy(F.desc("date"), "commodity"), "without_reading": without}


def _orders(e: Engine, city: str, since: str, query: str, limit: int) -> DataFrame:
    rows = e.tables["orders"]
    rows = rows.where(strings.city_key(F.col("city")) == strings.city_key(F.lit(city))) if city else rows
    rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else rows
    if query:
        q = query.lower()
        in_lines = F.exists("products", lambda p: F.lower(p).contains(q))
        rows = rows.where(F.lower("id").contains(q) | F.lower(F.coalesce("business_name", F.lit(""))).contains(q) | in_lines)
    return rows.orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def _record(e: Engine, body: str) -> dict:
    parsed = candidates.orders(e.spark.createDataFrame([(body,)], "body string")).collect()[0]
    if not parsed["ok"]:
        return {"recorded": False, "missing": parsed["missing"]}
    row = e.spark.createDataFrame([tuple(parsed[c] for c in e.tables["orders"].columns)], e.tables["orders"].schema)
    before = e.tables["orders"]
    new = before.where(F.col("id") == parsed["id"]).limit(1).count() == 0
    e.tables["orders"] = dedupe.insert_absent(before, row, "id", ["id"]).drop("inserted")
    return {"recorded": new, "id": parsed["id"]}


def _contacts(e: Engine, text: str) -> dict:
    return e.spark.createDataFrame([(text,)], "t string").select(contacts.extract_contacts(F.col("t")).alias("c")).collect()[0]["c"].asDict()


def _deadline(e: Engine, text: str, today: str) -> dict:
    row = e.spark.createDataFrame([(text,)], "t string").select(dates.find_deadline(F.col("t"), F.lit(today).cast("date")).alias("d")).collect()[0]
    return {"deadline": row["d"]}


def _render(e: Engine, max_chars: int) -> dict:
    text, index = digest.digest(e.tables["leads"], e.profile.section_caps, max_chars)
    return {"text": text, "index": index}


def _series(e: Engine, days: int, end: str) -> DataFrame:
    return series.dense_series(e.tables["prices"].withColumnRenamed("date", "day"), e.tables["items"], "commodity", "day", F.col("modal_price"), days, F.lit(end).cast("date"))


def _object(required: tuple = (), **props: dict) -> dict:
    return {"properties": props, "required": required}


_LIMIT = {"type": "integer", "minimum": 1, "maximum": 500, "default": 20}
TOOLS = {
    "leads.search": Tool(_search, _object(query=_text(default=""), status=_text(enum=["", *STATUSES], default=""), city=_text(default=""), kind=_text(default=""), segment=_text(default=""), min_score={"type": "integer", "minimum": 0, "maximum": 100, "default": 0}, limit=_LIMIT)),
    "leads.get": Tool(_get, _object(("id",), id=_text())),
    "leads.set_status": Tool(_set_status, _object(("id", "status"), id=_text(), status=_text(enum=list(STATUSES)), note=_text(1000, default="")), owner_only=True),
    "prices.get": Tool(_prices, _object(("end",), items={"type": "array", "items": {"type": "string"}, "default": []}, state=_text(default=""), days={"type": "integer", "minimum": 1, "maximum": 365, "default": 14}, end=_text())),
    "prices.series": Tool(_series, _object(("end",), days={"type": "integer", "minimum": 1, "maximum": 365, "default": 14}, end=_text())),
    "orders.list": Tool(_orders, _object(city=_text(default=""), since=_text(default=""), query=_text(default=""), limit={**_LIMIT, "default": 50})),
    "orders.record": Tool(_record, _object(("body",), body=_text(100_000)), owner_only=True),
    "contacts.extract": Tool(_contacts, _object(("text",), text=_text(200_000))),
    "deadline.read": Tool(_deadline, _object(("text", "today"), text=_text(200_000), today=_text())),
    "digest.render": Tool(_render, _object(max_chars={"type": "integer", "minimum": 100, "maximum": 4096, "default": 1500})),
}
