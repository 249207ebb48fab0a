"""Publishing a dataset: sanitised rows, statistics, charts, a card. Rows stay in Spark; only a report's few rows are drawn."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from parlance.operators.canonical import sanitize

#: Charts by the report's metric: file name, title.
CHARTS = {
    "turn_count_distribution": ("turn_count_distribution.svg", "Turn Count Distribution"),
    "avg_score_distribution": ("judge_avg_score_distribution.svg", "Judge Avg Score Distribution"),
    "words_histogram": ("word_count_distribution.svg", "Word Count Distribution"),
    "tokens_histogram": ("token_estimate_distribution.svg", "Token Estimate Distribution"),
}
BAR_AREA = 700


def gutter(labels: list[str]) -> int:
    """Pixels left of the bars: seven for each character of the longest label and some, within bounds."""
    return min(360, max(140, 7 * max(map(len, labels), default=0) + 24))


def bar_chart(title: str, items: list[tuple[str, float]]) -> str:
    """Horizontal bars as SVG, the longest as wide as the area."""
    left, most = gutter([label for label, _ in items]), max((v for _, v in items), default=0) or 1
    rows = []
    for k, (label, value) in enumerate(items):
        y, wide = 64 + 28 * k, int(BAR_AREA * max(0, value) / most)
        rows.append(
            f'<g font-family="sans-serif" font-size="13"><text x="16" y="{y + 18}">{escape(label)}</text>'
            f'<rect x="{left}" y="{y + 4}" width="{wide}" height="18" fill="#3b6ea8"/><text x="{left + wide + 8}" y="{y + 18}">{value:g}</text></g>'
        )
    body = "".join(rows) or '<text x="16" y="90">No data</text>'
    size = f'width="{left + BAR_AREA + 140}" height="{100 + 28 * len(items)}"'
    return f'<svg xmlns="http://www.w3.org/2000/svg" {size}><text x="16" y="34" font-size="22">{escape(title)}</text>{body}</svg>'


def card(repo_id: str, data_file: str, report: list[tuple[str, str, float]]) -> str:
    """The dataset's card: front matter that names one data file as the train split of the default config, then figures."""
    single = {m: v for m, b, v in report if not b}
    head = ["---", "configs:", "- config_name: default", "  data_files:", "  - split: train", f"    path: {data_file}", "---", "", f"# {repo_id.rsplit('/', 1)[-1]}", ""]
    lines = [f"- {m.replace('_', ' ')}: {v:g}" for m, v in single.items() if v is not None]
    lines += [f"- {b}: {int(v)}" for m, b, v in report if m == "languages"]
    return "\n".join(head + ["## Statistics", ""] + lines) + "\n"


def effective_source(requested: str, judged: str, judged_rows: int, plain: str) -> str:
    """The judged file in place of the plain one, if that was asked for and the judged one has rows."""
    return judged if requested == plain and judged_rows > 0 else requested


def write_bundle(lines: DataFrame, report: DataFrame, folder: str, *, repo_id: str, data_file: str = "train") -> list[str]:
    """Write sanitised rows (as Parquet, distributed), the report as JSON, the charts and the card; returns their names."""
    sanitize(lines).write.mode("overwrite").parquet(f"{folder}/{data_file}")
    rows = sorted(((r.metric, r.bucket, r.value) for r in report.collect()), key=lambda r: (r[0], _order(r[1])))
    texts = {"dataset_stats.json": json.dumps([{"metric": m, "bucket": b, "value": v} for m, b, v in rows], indent=2), "README.md": card(repo_id, data_file, rows)}
    for metric, (name, title) in CHARTS.items():
        items = [(b, v) for m, b, v in rows if m == metric]
        if items:
            texts[f"plots/{name}"] = bar_chart(title, items)
    for name, text in texts.items():
        write_text(lines.sparkSession, f"{folder.rstrip('/')}/{name}", text)
    return list(texts)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file in any store that Spark writes to, in place of one that is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _order(bucket: str) -> tuple:
    head = bucket.split("-")[0]
    return (0, float(head), bucket) if head.replace(".", "", 1).isdigit() else (1, 0.0, bucket)
