"""Overlay events: validation, and the ordered fold of those that change the set of bindings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The logged actions.
ACTIONS = ("set_label", "propagate_family_label", "merge_bindings", "split_binding", "override_binding", "disable_binding", "set_reconciliation_flag", "set_orphan_status")


def gaps(events: DataFrame, by: str = "overlay") -> DataFrame:
    """Events that break their overlay's sequence: ids must run from 1 without a gap, and actions be known."""
    w = Window.partitionBy(by).orderBy("id")
    d = events.withColumn("_want", F.row_number().over(w))
    why = F.when(F.col("id") != F.col("_want"), "id").when(~F.col("action").isin(*ACTIONS), "action")
    return d.select(by, "id", why.alias("fault")).where("fault IS NOT NULL")


def fold(events: DataFrame, strict: bool = True) -> DataFrame:
    """State of each overlay after its events (overlay, id, action, binding, value): (overlay, binding, label, flag, orphan, active, members).

    merge_bindings: value lists the bindings that join the named one; split_binding: value lists the new ones that take its place.
    An event on an unknown binding raises, or is skipped if not strict.  An overlay is one group: its events are ordered.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, dict] = {}
        for e in group.sort_values("id").itertuples(index=False):
            if e.action in ("set_label", "override_binding") and e.binding not in state:
                state[e.binding] = {"label": None, "flag": None, "orphan": False, "active": True, "members": [e.binding]}
            now = state.get(e.binding)
            if now is None or not now["active"]:
                if strict:
                    raise ValueError(f"event {e.id}: {e.binding} isn't active")
                continue
            if e.action in ("set_label", "propagate_family_label", "override_binding"):
                now["label"] = e.value
            elif e.action == "set_reconciliation_flag":
                now["flag"] = e.value
            elif e.action == "set_orphan_status":
                now["orphan"] = e.value == "true"
            elif e.action == "disable_binding":
                now["active"] = False
            else:
                others = json.loads(e.value)
                if e.action == "merge_bindings":
                    for o in others:
                        if o in state and o != e.binding:
                            now["members"] += state[o]["members"]
                            state[o]["active"] = False
                else:
                    now["active"] = False
                    for o in others:
                        state[o] = {"label": now["label"], "flag": now["flag"], "orphan": False, "active": True, "members": [o]}
        rows = [(group["overlay"].iloc[0], b, s["label"], s["flag"], s["orphan"], s["active"], sorted(s["members"])) for b, s in sorted(state.items())]
        return pd.DataFrame(rows, columns=["overlay", "binding", "label", "flag", "orphan", "active", "members"])

    kind = dict(events.dtypes)["overlay"]
    return events.groupBy("overlay").applyInPandas(one, f"overlay {kind}, binding string, label string, flag string, orphan boolean, active boolean, members array<string>")
