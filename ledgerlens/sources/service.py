"""Answers over precomputed lists: the rules of the service, and an HTTP application where FastAPI is installed."""

from __future__ import annotations

from typing import Any

MOST = 100


def normalised(item: Any) -> dict:
    """{item_id, score} of whatever a model returns for an item: a mapping, a pair or a bare id."""
    if isinstance(item, dict):
        for name in ("item_id", "item_idx", "id"):
            if name in item:
                return {"item_id": item[name], "score": item.get("score")}
        raise ValueError("an item needs item_id, item_idx or id")
    if isinstance(item, (tuple, list)):
        return {"item_id": item[0], "score": item[1] if len(item) > 1 else None}
    return {"item_id": item, "score": None}


def answer(model: Any, customer: Any, top_k: int = 10) -> tuple[int, Any]:
    """(status, body): 503 without a model, 422 for a bad top_k, 404 for an unknown customer, 500 for other errors."""
    if model is None:
        return 503, {"detail": "no model"}
    if not 1 <= top_k <= MOST:
        return 422, {"detail": f"top_k is 1 to {MOST}"}
    try:
        return 200, {"customer_id": customer, "items": [normalised(x) for x in model.recommend(customer, top_k)]}
    except KeyError:
        return 404, {"detail": f"unknown customer {customer}"}
    except Exception as error:
        return 500, {"detail": str(error)}


def create_app(model: Any = None):
    from fastapi import Body, FastAPI
    from fastapi.responses import JSONResponse

    app = FastAPI()

    @app.get("/health")
    def health():
        return {"status": "ok", "model": model is not None}

    @app.post("/recommend")
    def recommend(body: dict = Body(...)):
        status, out = answer(model, body.get("customer_id"), int(body.get("top_k", 10)))
        return JSONResponse(out, status_code=status)

    return app
