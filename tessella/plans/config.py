"""Settings of the trainers, from text or keyword arguments.

Text is one ``key = value`` (or ``key : value``) a line, quoted strings and nested
``name { ... }`` blocks included; a ``#`` outside quotes starts a comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from tessella.functions.losses import LossKind

_TOKEN = re.compile(r"""\s*(?:#[^\n]*|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([{}=:,;])|([^\s{}=:,;"'#]+))""")


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def parse_text(text: str) -> dict:
    """Nested dictionaries; a repeated key becomes a list."""
    tokens = [m for m in _TOKEN.finditer(text) if m[1] or m[2] or m[3]]
    at = 0

    def block(inner: bool) -> dict:
        nonlocal at
        out: dict = {}
        while at < len(tokens):
            t = tokens[at]
            if t[2] == "}":
                if not inner:
                    raise ValueError("'}' without '{'")
                at += 1
                return out
            if t[2] in (",", ";"):
                at += 1
                continue
            key, at = t[3] or t[1].strip("\"'"), at + 1
            if at < len(tokens) and tokens[at][2] in ("=", ":"):
                at += 1
            if at >= len(tokens):
                raise ValueError(f"{key} has no value")
            t, at = tokens[at], at + 1
            value = block(True) if t[2] == "{" else t[1][1:-1] if t[1] else _value(t[3])
            if key in out:
                value = (out[key] if isinstance(out[key], list) else [out[key]]) + [value]
            out[key] = value
        if inner:
            raise ValueError("'{' without '}'")
        return out

    return block(False)


@dataclass(frozen=True)
class Embedding:
    dim: int = 0
    threshold: int = 0
    lambda_l2: float = 0.0
    lr_eta: float | None = None
    lr_beta: float | None = None
    init_scale: float = 0.01
    dropout: float = 0.0
    grad_clipping: float = 0.0
    grad_normalization: float = 0.0


@dataclass(frozen=True)
class LearnConfig:
    """Settings of the online trainers.  ``lr_eta`` unset means 0.1 for linear models, 0.01 for factorization machines."""

    train_data: str | None = None
    val_data: str | None = None
    data_format: str = "libsvm"
    model_out: str | None = None
    model_in: str | None = None
    predict_out: str | None = None
    loss: LossKind = LossKind.LOGIT
    algo: str = "ftrl"
    lambda_l1: float = 1.0
    lambda_l2: float = 0.0
    lr_eta: float | None = None
    lr_beta: float = 1.0
    minibatch: int = 1000
    max_data_pass: int = 10
    save_iter: int = -1
    load_iter: int = -1
    num_parts_per_file: int = 10
    rand_shuffle: int = 10
    neg_sampling: float = 1.0
    prob_predict: bool = True
    local_data: bool = False
    print_sec: int = 1
    max_concurrency: int = 2
    fixed_bytes: int = 0
    early_stop: bool = False
    min_objv_decr: float = 1e-5
    max_objv: float | None = None
    l1_shrk: bool = True
    embedding: Embedding = field(default_factory=Embedding)

    @staticmethod
    def load(text: str = "", **over) -> LearnConfig:
        """From text, then keyword arguments over it; unknown keys are an error."""
        got = parse_text(text) | over
        known = {f.name for f in fields(LearnConfig)}
        if unknown := set(got) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        e = got.pop("embedding", Embedding())
        e = e[0] if isinstance(e, list) else e  # the first of several counts
        if "loss" in got:
            got["loss"] = LossKind(str(got["loss"]).lower())
        if "algo" in got:
            got["algo"] = str(got["algo"]).lower()
        return replace(LearnConfig(), embedding=Embedding(**e) if isinstance(e, dict) else e, **got)


def parse_args(args: list[str]) -> dict:
    """``name=value`` arguments."""
    pairs = [a.partition("=") for a in args]
    if bad := [a for a, eq, _ in pairs if not eq]:
        raise ValueError(f"not name=value: {', '.join(bad)}")
    return {k.strip(): _value(v.strip()) for k, _, v in pairs}
