"""The OpenAPI document, made from the parameter table; the same bytes each time."""

from __future__ import annotations

import json

from .params import PARAMS

#: The stable error codes and their statuses; fixed values.
CODES = {"validation_error": 422, "bad_request": 400, "unauthorized": 401, "not_found": 404, "method_not_allowed": 405, "backend_unavailable": 503, "internal_error": 500}
_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
FLOW = {
    n: _TEXT if n.endswith(("_at", "_switched", "_addr", "_type")) else {"type": ["string", "null"]} if n == "next_hop" else _WHOLE
    for n in "received_at exporter_id exporter_addr flow_type first_switched last_switched src_addr dst_addr src_port dst_port protocol tcp_flags packets bytes sampling_rate input_iface output_iface src_as dst_as next_hop".split()
}
EXPORTER = {"id": _WHOLE, "ip_address": _TEXT, "label": {"type": ["string", "null"]}, "first_seen_at": _TEXT, "last_seen_at": _TEXT}


def _object(properties: dict, required: list[str] | None = None) -> dict:
    return {"type": "object", "properties": properties, "required": sorted(properties) if required is None else required}


def document(version: str = "1") -> dict:
    ref = lambda n: {"$ref": f"#/components/schemas/{n}"}
    body = lambda schema: {"application/json": {"schema": schema}}

    def operation(what: str, item: str, params: list, codes: list[str]) -> dict:
        page = _object({"data": {"type": "array", "items": ref(item)}, "meta": ref("Meta")})
        answers = {str(CODES[c]): {"description": c, "content": body(ref("Error"))} for c in codes}
        shown = [{"name": p.name, "in": "query", "required": p.required, "description": p.what, "schema": p.schema | ({"minimum": p.least} if p.least is not None else {}) | ({"maximum": p.most} if p.most is not None else {})} for p in params]
        return {"get": {"summary": what, "parameters": shown, "security": [{"bearer": []}], "responses": {"200": {"description": "A page.", "content": body(page)}} | answers}}

    details = {"type": "array", "items": _object({"field": _TEXT, "message": _TEXT})}
    error = _object({"code": {"type": "string", "enum": list(CODES)}, "message": _TEXT, "details": details, "request_id": _TEXT}, ["code", "message", "request_id"])
    common = ["unauthorized", "method_not_allowed", "backend_unavailable", "internal_error"]
    return {
        "openapi": "3.1.0", "info": {"title": "Flow records", "version": version},
        "paths": {
            "/v1/flows": operation("Flows of a time range, newest first.", "Flow", PARAMS, ["bad_request", "validation_error", *common]),
            "/v1/exporters": operation("All exporters by id.", "Exporter", [], ["validation_error", *common]),
        },
        "components": {
            "securitySchemes": {"bearer": {"type": "http", "scheme": "bearer"}},
            "schemas": {"Flow": _object(FLOW), "Exporter": _object(EXPORTER), "Meta": _object({"has_more": {"type": "boolean"}, "next_cursor": _TEXT}, ["has_more"]), "Error": _object({"error": error})},
        },
    }


def dump() -> str:
    return json.dumps(document(), indent=2, sort_keys=True) + "\n"
