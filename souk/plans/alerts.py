"""Alerts of failed steps: a line in a file, and a message to a webhook. An alert that can't be delivered hides no failure."""

from __future__ import annotations

import datetime as dt
import json
import os
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

from souk.plans import flow

MOST_CHARACTERS = 500


def post(url: str, body: bytes) -> None:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"}, method="POST")
    urllib.request.urlopen(request, timeout=10).close()


def raise_alerts(job: str, run_id: str, outcomes: Iterable[flow.Outcome], file: str | None = None, webhook: str | None = None, send: Callable[[str, bytes], None] = post) -> list[dict]:
    """One alert for each step that failed for good; places by default from ALERT_LOG and ALERT_WEBHOOK_URL. Returns the alerts, each
    with the channels that could not be reached."""
    file, webhook = file or os.environ.get("ALERT_LOG"), webhook or os.environ.get("ALERT_WEBHOOK_URL")
    out = []
    for x in outcomes:
        if x.state != flow.FAILED:
            continue
        alert = {"raised_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "job": job, "step": x.name, "run_id": run_id, "tries": x.tries, "error": (x.error or "")[:MOST_CHARACTERS]}
        lost = []
        if file:
            try:
                Path(file).parent.mkdir(parents=True, exist_ok=True)
                with open(file, "a", encoding="utf-8") as f:
                    f.write(json.dumps(alert, ensure_ascii=False) + "\n")
            except OSError as e:
                lost.append(f"file: {e}")
        if webhook:
            try:
                send(webhook, json.dumps({"text": f"{job}: {x.name} failed after {x.tries} tries in run {run_id}. {alert['error']}"}).encode())
            except Exception as e:  # noqa: BLE001  whatever the network does
                lost.append(f"webhook: {e}")
        out.append(alert | {"undelivered": lost})
    return out
