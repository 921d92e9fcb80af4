"""Pages rendered by a browser program on the executors."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pagestrata.functions.given import first_given

#: How a browser is asked for a page's final document, and the programs looked for where none is named.
ARGUMENTS = ["--headless", "--disable-gpu", "--dump-dom", "--hide-scrollbars", "--no-first-run", "--no-default-browser-check", "--virtual-time-budget=20000"]
BROWSERS = ["chromium", "chromium-browser", "google-chrome", "google-chrome-stable", "chrome", "msedge"]


def browser(*given: str | None) -> str | None:
    """The first program that is given (argument, source, config), or else the first that is installed."""
    return first_given(*given) or next((b for b in BROWSERS if shutil.which(b)), None)


def render(pages: DataFrame, program: str, proxy: str | None = None) -> DataFrame:
    """(url, rendered_html, error) of each page (url); a page that fails has its error and no document."""
    through = [f"--proxy-server={proxy}"] if proxy else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    done = subprocess.run([program, *ARGUMENTS, *through, url], capture_output=True)
                    good = done.returncode == 0
                    rows.append((url, done.stdout.decode("utf-8", "replace") if good else None, None if good else f"exit {done.returncode}: {done.stderr.decode('utf-8', 'replace').strip()}"))
                except OSError as trouble:
                    rows.append((url, None, str(trouble)))
            yield pd.DataFrame(rows, columns=["url", "rendered_html", "error"])

    return pages.select("url").mapInPandas(run, "url string, rendered_html string, error string")
