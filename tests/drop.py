"""A small JSON drop with every irregularity the readers must cope with."""

import json
from pathlib import Path

from paylens.schemas import DROP_PATHS


def _write(root, table, slug, year, quarter, content):
    folder = Path(root) / DROP_PATHS[table] / slug / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{quarter}.json").write_text(json.dumps(content, indent=1))


def category(name, *instruments):
    return {"name": name, "paymentInstruments": [
        {"type": "TOTAL", "count": c, "amount": a} for c, a in instruments
    ]}


def district(name, *metrics):
    return {"name": name, "metric": [{"type": "TOTAL", "count": c, "amount": a} for c, a in metrics]}


def pincode(code, count, amount):
    return {"entityName": code, "metric": {"type": "TOTAL", "count": count, "amount": amount}}


def write_drop(root):
    def put(table, slug, year, quarter, data):
        _write(root, table, slug, year, quarter, {"success": True, "data": data})

    islands, jk, tamil = "andaman-&-nicobar-islands", "jammu-&-kashmir", "tamil-nadu"
    put("agg_trans", islands, 2018, 1, {"transactionData": [
        category("Recharge & bill payments", (3, 10.5), (99, 99.0)),
        category("Peer-to-peer payments", (4, 20.25)),
    ]})
    put("agg_trans", jk, 2018, 2, {"transactionData": [category("Others", (1, 0.1))]})
    put("agg_trans", tamil, 2019, 4, {"from": 1})
    _write(root, "agg_trans", tamil, 2019, 3, {"success": False})

    put("agg_ins", tamil, 2020, 2, {"transactionData": [category("Insurance", (6, 1360.0))]})
    put("agg_ins", jk, 2020, 2, {"transactionData": []})

    put("agg_user", tamil, 2018, 1, {"aggregated": {"registeredUsers": 9}, "usersByDevice": [
        {"brand": "Xiaomi", "count": 5, "percentage": 0.625},
        {"brand": "COOLPAD", "count": 3, "percentage": 0.375},
    ]})
    put("agg_user", jk, 2022, 2, {"aggregated": {}, "usersByDevice": None})

    put("map_trans", islands, 2018, 1, {"hoverDataList": [
        district("nicobars district", (2, 5.0), (7, 7.0)),
        district("nicobar district", (1, 4.0)),
        district("north  and-middle andaman district", (8, 80.0)),
    ]})
    put("map_trans", jk, 2018, 1, {"hoverDataList": []})

    put("map_ins", islands, 2020, 2, {"hoverDataList": [
        district("nicobars district", (2, 5.0)),
        district("south andaman district"),
        {"name": "north district"},
    ]})
    put("map_ins", jk, 2020, 2, {"hoverDataList": []})
    put("map_ins", tamil, 2020, 3, {})
    _write(root, "map_ins", tamil, 2020, 4, {"success": False})

    put("map_user", islands, 2018, 1, {"hoverData": {
        "nicobars district": {"registeredUsers": 7, "appOpens": 0},
        "south andaman district": {"registeredUsers": 20, "appOpens": 50},
    }})
    put("map_user", jk, 2018, 1, {"hoverData": None})

    put("top_trans", tamil, 2018, 1, {"districts": [], "pincodes": [
        pincode("600001", 4, 44.0), pincode("600002", 3, 33.5),
    ]})
    put("top_ins", tamil, 2020, 2, {"pincodes": [pincode("600001", 1, 9.0)]})
    put("top_user", tamil, 2018, 1, {"pincodes": [
        {"name": "600001", "registeredUsers": 12}, {"name": "600002", "registeredUsers": 8},
    ]})
    return str(root)
