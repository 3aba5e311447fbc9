"""Reports of a few collected rows, as Markdown and JSON, and the record of a run."""

from __future__ import annotations

import json
import platform
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame

from veilmark.operators.detector import strongest
from veilmark.operators.stats import benjamini_hochberg

POWER = "With {n} matched pairs an AUC below about {r:.2f} cannot be told from 0.5; a barrier that is not seen may still be there."


def _interval(point: float, lo: float | None, hi: float | None) -> str:
    return f"{point:.3f}" if lo is None or hi is None else f"{point:.3f} [{lo:.3f}, {hi:.3f}]"


def comparison(table: DataFrame) -> str:
    """The comparison of methods (one row each)."""
    rows = table.collect()
    out = ["| method | worst leak@k | AUC | interval | state | verdict |", "|-|-|-|-|-|-|"]
    out += [f"| {r['method']} | {r['worst_leak']:.3f} | {r['auc']:.3f} | [{r['lo']:.3f}, {r['hi']:.3f}] | {r['state']} | {r['verdict']} |" for r in rows]
    open_ = sum(r["state"] == "inconclusive" for r in rows)
    if open_:
        out += ["", f"{open_} of {len(rows)} methods are not resolved by so few pairs; nothing is claimed of them."]
    return "\n".join(out) + "\n"


def audit(method: str, leak: DataFrame, detectors: DataFrame, n_pairs: int, coefficients: DataFrame | None = None, utility: DataFrame | None = None, run: dict | None = None, limitations: list[str] | None = None) -> str:
    """One method: the run, leaks by family, both detectors, what told most, utility, and what so many pairs can resolve."""
    out = [f"# {method}", ""]
    if run:
        out += ["## Run", "", *(f"- {k}: {v}" for k, v in run.items()), ""]
    out += ["## Leaks", "", "| family | k | leak@1 | leak@k | probes |", "|-|-|-|-|-|"]
    for r in (x.asDict() for x in leak.orderBy("family").collect()):
        one, many = (_interval(r[c], r.get(f"{c}_lo"), r.get(f"{c}_hi")) for c in ("leak_at_1", "leak_at_k"))
        out.append(f"| {r['family']} | {r['k']} | {one} | {many} | {r['n_probes']} |")
    out += ["", "## Detectability", ""]
    for p in (x.asDict() for x in detectors.collect()):
        spread = max(p["auc_by_repeat"]) - min(p["auc_by_repeat"])
        chance = "" if p.get("p") is None else f", p {p['p']:.4f}"
        out += [f"{p.get('detector', 'AUC')}: AUC {_interval(p['auc'], p['lo'], p['hi'])}{chance}, {p['state']}; over repeats it moves by {spread:.3f}.", ""]
    if coefficients is not None:
        out += ["| feature | coefficient |", "|-|-|", *(f"| {r['feature']} | {_interval(r['point'], r['lo'], r['hi'])} |" for r in strongest(coefficients).orderBy("place").collect()), ""]
    if utility is not None:
        u = utility.first()
        out += ["## Utility", "", f"Direct probes of the entitled side keep {_interval(u['point'], u['lo'], u['hi'])}.", ""]
    out.append(POWER.format(n=n_pairs, r=0.5 + 1.96 * (1 / 6 / max(n_pairs, 1)) ** 0.5))
    if limitations:
        out += ["", "## Limitations", "", *(f"- {x}" for x in limitations)]
    return "\n".join([*out, ""])


def adjust_secondary(tests: DataFrame, primary: str = "logreg_primary", q: float = 0.1) -> DataFrame:
    """Adjusted p-values of all detectors but the primary one; missing p-values are left out."""
    return benjamini_hochberg(tests.where(f"name <> '{primary}' and p is not null and not isnan(p)"), q=q)


def limitations(tier: str, synthetic: bool, n_pairs: int, method: str, cached_share: float) -> list[str]:
    """What a reader must know before quoting a result."""
    out = []
    if tier == "stub":
        out.append("Texts come from a deterministic stand-in, not from a language model: only the order of methods means something.")
    if synthetic:
        out.append("The corpus is made up; figures and names are no company's.")
    if n_pairs < 20:
        out.append(f"{n_pairs} pairs resolve only large effects.")
    if method == "lora_ga":
        out.append("Unlearning is stood in for by suppressing the numbers of the dev side's artifacts.")
    if cached_share > 0:
        out.append(f"{cached_share:.0%} of the generations were read from a cache; their latency is no feature.")
    return out


def versions(packages: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    found = {}
    for p in packages:
        try:
            found[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            found[p] = "none"
    return {"python": platform.python_version(), **found}


def run_record(run_id: str, config_hash: str, split: DataFrame, generations: int, cached: int, seconds: float) -> dict:
    """What a result was made from: hashes, counts, time, versions. split: one row of `splits.audit`."""
    return {"run_id": run_id, "config_hash": config_hash, **split.first().asDict(), "generations_total": generations, "generations_from_cache": cached, "elapsed_seconds": round(seconds, 1), "versions": versions()}


def write(folder: str, name: str, markdown: str, value: object) -> tuple[Path, Path]:
    """name.md and name.json in a folder of the driver: reports are a few rows."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    md, js = out / f"{name}.md", out / f"{name}.json"
    md.write_text(markdown, encoding="utf-8")
    js.write_text(json.dumps(value, indent=2, sort_keys=True, default=str), encoding="utf-8")
    return js, md


def write_comparison(folder: str, table: DataFrame, tests: DataFrame | None = None) -> tuple[Path, Path]:
    """The comparison with the secondary detectors' adjusted p-values. tests: name, p."""
    adjusted = {r["name"]: r["p_adjusted"] for r in adjust_secondary(tests).collect()} if tests is not None else {}
    return write(folder, "comparison", comparison(table), {"methods": [r.asDict() for r in table.collect()], "secondary_adjusted_p": adjusted})


def write_curve(folder: str, rows: DataFrame) -> tuple[Path, Path]:
    """The curve of AUC and leak against retry budgets."""
    found = rows.collect()
    lines = ["| method | retries | worst leak@k | AUC |", "|-|-|-|-|", *(f"| {r['method']} | {'' if r['retries'] is None else r['retries']} | {r['worst_leak']:.3f} | {_interval(r['auc'], r['lo'], r['hi'])} |" for r in found)]
    return write(folder, "retry_curve", "\n".join(lines) + "\n", [r.asDict() for r in found])


def write_workspace(folder: str, tables: dict[str, DataFrame], manifest: DataFrame, split: DataFrame) -> None:
    """Each table as JSON lines by Spark; the manifest and the split's audit (one row each) as JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    spark = manifest.sparkSession
    for name, one in (("manifest", manifest), ("split_audit", split)):
        spark.createDataFrame([(json.dumps(one.first().asDict(), sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def write_quarantine(bad: DataFrame, folder: str, payload: str = "payload", most: int = 4000) -> None:
    """Rows that could not be read, their payload cut."""
    from pyspark.sql import functions as F

    bad.withColumn(payload, F.substring(payload, 1, most)).write.mode("append").json(folder)
