"""A whole evaluation: metrics of a scored corpus with the threshold taken from its training part."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .features import FEATURE_NAMES, dimension


def evaluate(rows: DataFrame, train: DataFrame | None = None, threshold: float | None = None, key: str = "id", label: str = "y", reps: int = 2000) -> dict:
    """Metrics of rows with score, label, features, question, domain, source, era and text.

    Features are judged on values that are there, before any stand-in. Without a threshold the best of the training part
    counts, or 2.5 without one. Only aggregates and the report's examples come to the driver."""
    names = [n for n in [*FEATURE_NAMES, "ll_perplexity", "ll_mean_logprob", "ll_surprisal_stdev", "ll_binoculars"] if n in rows.columns]
    one = lambda df: df.first().asDict()
    # scored once: ten aggregates read these columns; of the text only what a report shows
    kept = [c for c in dict.fromkeys([key, label, "score", *names, "question", "domain", "source", "era"]) if c in rows.columns]
    cached = rows = rows.select(*kept, F.substring("text", 1, 280).alias("text")).persist()
    if threshold is None:
        threshold = one(stats.best_threshold(train, "score", label))["threshold"] if train is not None else 2.5
    long = rows.select(label, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([label], names, "feature", "value")
    directions = dimension(rows.sparkSession).select("feature", "direction")
    beside = tuple(c for c in ("domain", "source", "sentence_cv", "type_token_ratio") if c in rows.columns)
    wrong = stats.misclassified(rows, key, "score", label, threshold, beside=beside).collect()
    sides = lambda df: one(df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) != 1).alias("n_neg")))
    parts = {"test": sides(rows)} | ({"train": sides(train)} if train is not None else {})
    leaky = one(stats.best_threshold(rows, "score", label))["threshold"]
    slices: dict[str, dict] = {}
    for r in stats.slice_auc(rows, "score", label, [k for k in ("domain", "source", "era") if k in rows.columns]).collect():
        slices.setdefault(f"{r.slice}_auc", {})[r.value] = round(r.auc, 4)
    ci = one(stats.bootstrap_auc_ci(rows, "score", label, reps))
    out = {
        "parts": parts, **one(stats.auc(rows, "score", label)), "auc_ci95": [ci["lo"], ci["hi"]], "paired": one(stats.paired_auc(rows, "question", key, "score", label)) if "question" in rows.columns else {},
        "score_dist": {str(r[label]): r.asDict() for r in stats.dist(rows, "score", [label]).collect()},
        "operating_threshold": one(stats.confusion_at(rows, "score", label, threshold)), "leaky_best_f1": one(stats.confusion_at(rows, "score", label, leaky)),
        "feature_auc": {r.feature: r.asDict() for r in stats.feature_auc(long, label, directions).collect()}, **slices,
        "false_positives": [r.asDict() for r in wrong if r.kind == "fp"], "false_negatives": [r.asDict() for r in wrong if r.kind == "fn"],
    }
    cached.unpersist()
    return out


def write_report(metrics: dict, folder: str, corpus: str = "", split: str = "") -> None:
    """metrics.json, report.md and misclassified.md. `corpus` and `split` say what was evaluated."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "metrics.json").write_text(json.dumps({"meta": {"corpus": corpus, "split": split}, **metrics}, indent=2), encoding="utf-8")
    of = [f"Corpus: {corpus or 'not named'}; part evaluated: {split or 'all'}.", *(f"Rows of the {k} part: {v['n_pos']} machine, {v['n_neg']} human." for k, v in metrics["parts"].items())]
    lines = ["# Evaluation", "", *of, "", f"AUC {metrics['auc']} (95 % from {metrics['auc_ci95'][0]} to {metrics['auc_ci95'][1]}), {metrics['n_pos']} machine and {metrics['n_neg']} human texts.", "", "| feature | direction | coverage | AUC |", "|---|---|---|---|"]
    lines += [f"| {r['feature']} | {r['direction']} | {r['coverage']} | {r['auc']} |" for r in sorted(metrics["feature_auc"].values(), key=lambda r: -(r["auc"] or 0))]
    for name, values in metrics.items():
        if name.endswith("_auc") and name != "feature_auc":
            lines += ["", f"## {name}", "", *(f"- {k}: {v}" for k, v in sorted(values.items()))]
    for title, name in (("At the operating threshold", "operating_threshold"), ("At the best F1 of these very rows, which flatters", "leaky_best_f1")):
        r = metrics[name]
        lines += ["", f"## {title}", "", "| threshold | true + | false + | false - | true - | accuracy | precision | recall | F1 |", "|" + "---|" * 9, f"| {r['threshold']} | {r['tp']} | {r['fp']} | {r['fn']} | {r['tn']} | {r['accuracy']:.3f} | {r['precision']:.3f} | {r['recall']:.3f} | {r['f1']:.3f} |"]
    if metrics["paired"].get("pairs"):
        r = metrics["paired"]
        lines += ["", "## Questions with both sides", "", f"Machine side higher in {r['wins']} of {r['pairs']}, equal in {r['ties']}, lower in {r['losses']}: {r['paired_auc']:.3f}. Mean difference {r['mean_delta']:.3f}."]
    lines += ["", "## Scores", "", "| label | n | mean | median | p25 | p75 | min | max |", "|" + "---|" * 8]
    lines += [f"| {k} | {r['n']} | {r['mean']:.3f} | {r['median']} | {r['p25']} | {r['p75']} | {r['min']} | {r['max']} |" for k, r in sorted(metrics["score_dist"].items())]
    (out / "report.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    wrong = ["# Misclassified", ""]
    for kind in ("false_positives", "false_negatives"):
        wrong += [f"## {kind.replace('_', ' ')}", "", *(_wrong(r) for r in metrics[kind]), ""]
    (out / "misclassified.md").write_text("\n".join(wrong), encoding="utf-8")


def _wrong(r: dict) -> str:
    facts = [f"{k} {round(v, 3) if isinstance(v, float) else v}" for k, v in r.items() if k not in ("kind", "rank", "snippet") and v is not None]
    return f"- {', '.join(facts)}: {r['snippet']}"


def drift_report(rows: DataFrame, path: str, label: str = "y", metrics: dict[str, bool] | None = None) -> str:
    """A table of each group's size, median score and AUC against pooled human rows, as Markdown at `path`.

    Groups are few (source, era and model); only they come to the driver."""
    metrics = metrics or {"score": False, **{m: True for m in ("ll_perplexity", "ll_binoculars", "ll_surprisal_stdev") if m in rows.columns}}
    found: dict[str, dict] = {}
    for r in stats.drift(rows, label, metrics).orderBy("grp").collect():
        found.setdefault(r.grp, {})[r.metric] = r
    first = next(iter(metrics))
    shown = lambda x: "—" if x is None else f"{x:.3f}"
    lines = ["# Groups against pooled human texts", "", "| group | n | median | " + " | ".join(f"{m} AUC" for m in metrics) + " |", "|" + "---|" * (3 + len(metrics))]
    for grp, by in found.items():
        base = by.get(first) or next(iter(by.values()))
        lines.append(f"| {grp} | {base.n} | {base['median']} | " + " | ".join(shown(by[m].auc if m in by else None) for m in metrics) + " |")
    text = "\n".join(lines) + "\n"
    Path(path).write_text(text, encoding="utf-8")
    return text
