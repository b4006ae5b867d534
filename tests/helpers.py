"""Small typed tables for the tests."""

from __future__ import annotations

import datetime as dt

from opsloom import schemas
from opsloom.sources.tables import Tables


def key(n: int) -> bytes:
    """A 16-byte id."""
    return n.to_bytes(16, "big")


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


DEFAULTS = {
    "created_at": at("2024-01-01 00:00:00"),
    "updated_at": at("2024-01-01 00:00:00"),
    "email_verified": True,
    "reason": "r",
    "content": "text",
    "available": True,
    "price_in_cents": 100,
    "started_at": None,
    "generated_at": at("2024-01-01 00:00:00"),
}


def frame(spark, schema, rows: list[dict]):
    data = [tuple(row.get(f.name, DEFAULTS.get(f.name)) for f in schema.fields) for row in rows]
    return spark.createDataFrame(data, schema)


def tables(spark, **rows: list[dict]) -> Tables:
    """All current-state tables with the given rows (others empty)."""
    frames = {name: frame(spark, schema, rows.get(name, [])) for name, schema in schemas.CURRENT_STATE_TABLES.items()}
    frames["drafts"] = frame(spark, schemas.AGENT_RESPONSE_SCHEMA, rows.get("drafts", []))
    for name, schema in (
        ("carts", schemas.CARTS),
        ("cart_items", schemas.CART_ITEMS),
        ("promotions", schemas.PROMOTIONS),
        ("runs", schemas.RUNS),
        ("configs", schemas.RUN_CONFIGS),
    ):
        if name in rows:
            frames[name] = frame(spark, schema, rows[name])
    return Tables(spark, frames)


def user(n: int, region: str | None = "us_east") -> dict:
    return {"id": f"u{n}", "name": f"User {n}", "email": f"u{n}@example.org", "region": region}


def order(n: int, user_id: str, cents: int, when: str, status: str = "delivered") -> dict:
    return {"id": key(n), "user_id": user_id, "status": status, "total_in_cents": cents, "created_at": at(when)}


def case(n: int, user_id: str, when: str, status: str = "open", subject: str = "Late delivery") -> dict:
    return {"id": key(n), "user_id": user_id, "subject": subject, "status": status, "created_at": at(when)}


def message(n: int, case_id: int, when: str, admin: int | None = None, text: str = "hello") -> dict:
    return {
        "id": key(n),
        "case_id": key(case_id),
        "user_id": None if admin else "u1",
        "admin_id": key(admin) if admin else None,
        "content": text,
        "created_at": at(when),
    }


def rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def one(df) -> dict:
    found = rows(df)
    assert len(found) == 1, found
    return found[0]
