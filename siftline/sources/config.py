"""Settings from YAML files: policies and hosts, read on the driver (a handful of small files)."""

from pathlib import Path

from siftline.operators.policies import errors, merged


def read(folder: str, defaults: dict | None = None) -> list[dict]:
    """The documents of a folder's .yaml files, by name, over `defaults`; a domain list written a|b stays one pattern."""
    import yaml

    docs = [yaml.safe_load(p.read_text()) or {} for p in sorted(Path(folder).glob("*.y*ml"))]
    return [merged(defaults or {}, d) for d in docs]


def policies(folder: str) -> list[dict]:
    """Valid policies; a file with a faulty one stops the run, as a page mustn't pass unfiltered for it."""
    found = read(folder)
    for p in found:
        if wrong := errors(p):
            raise ValueError(f"policy {p.get('name')!r}: {'; '.join(wrong)}")
    return found
