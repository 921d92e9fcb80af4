"""Repositories as file trees: cloned by the git program into a folder that the executors share."""

from __future__ import annotations

import subprocess


def run(arguments: list[str], folder: str | None = None, proxy: str | None = None) -> str:
    """What git prints; a failure raises RuntimeError with its own words."""
    through = ["-c", f"http.proxy={proxy}"] if proxy else []
    done = subprocess.run(["git", *through, *arguments], cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]}: {done.stderr.strip()}")
    return done.stdout.strip()


def checkout(repo: str, folder: str, ref: str | None = None, proxy: str | None = None) -> str:
    """Clones ``repo`` into the empty ``folder``, checks ``ref`` out (the default branch if none) and returns the commit."""
    run(["clone", "--quiet", "--no-checkout", repo, folder], proxy=proxy)
    run(["checkout", "--quiet", ref or "HEAD"], folder, proxy)
    return run(["rev-parse", "HEAD"], folder)
