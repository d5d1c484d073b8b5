"""The same expressions as SQL text for DuckDB, in the same order of additions."""

from __future__ import annotations

from ..functions.months import MONTHS, SERIES, column


def cols(series: str) -> list[str]:
    return [column(series, m) for m in MONTHS]


def row_sum(c: list[str]) -> str:
    return "(" + " + ".join(c) + ")"


def row_mean(c: list[str]) -> str:
    return f"({row_sum(c)} / 12)"


def whole(c: list[str], x: str) -> str:
    return f"(case when {row_sum(c)} is not null then {x} end)"


def row_max(c: list[str]) -> str:
    return whole(c, f"greatest({', '.join(c)})")


def row_min(c: list[str]) -> str:
    return whole(c, f"least({', '.join(c)})")


def row_std(c: list[str]) -> str:
    m = row_mean(c)
    return "sqrt((" + " + ".join(f"({x} - {m}) * ({x} - {m})" for x in c) + ") / 12)"


def diff(a: list[str], b: list[str]) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b, strict=True)]


def quarters(c: list[str]) -> list[str]:
    return [f"({c[i]} + {c[(i + 1) % 12]} + {c[(i + 2) % 12]})" for i in range(12)]


def arg(c: list[str], which: str) -> str:
    q = f"[{', '.join(quarters(c))}]"
    return whole(c, f"cast(list_position({q}, list_{which}({q})) - 1 as int)")


def quarter_mean(c: list[str], start: str) -> str:
    return f"([{', '.join(quarters(c))}][{start} + 1] / 3)"


def indicators() -> dict[str, str]:
    tas, tasmax, tasmin, pr = (cols(s) for s in SERIES)
    wet, dry, warm, cold = arg(pr, "max"), arg(pr, "min"), arg(tas, "max"), arg(tas, "min")
    bio02, bio05, bio06 = row_mean(diff(tasmax, tasmin)), row_max(tasmax), row_min(tasmin)
    return {
        "bio01": row_mean(tas),
        "bio02": bio02,
        "bio03": f"100 * {bio02} / nullif({bio05} - {bio06}, 0)",
        "bio04": f"100 * {row_std(tas)}",
        "bio05": bio05,
        "bio06": bio06,
        "bio07": f"{bio05} - {bio06}",
        "bio08": quarter_mean(tas, wet),
        "bio09": quarter_mean(tas, dry),
        "bio10": quarter_mean(tas, warm),
        "bio11": quarter_mean(tas, cold),
        "bio12": row_sum(pr),
        "bio13": row_max(pr),
        "bio14": row_min(pr),
        "bio15": f"case when {row_mean(pr)} > 0 then 100 * {row_std(pr)} / {row_mean(pr)} end",
        "bio16": quarter_mean(pr, wet),
        "bio17": quarter_mean(pr, dry),
        "bio18": quarter_mean(pr, warm),
        "bio19": quarter_mean(pr, cold),
    }


def select(cells: dict[str, str], source: str, kind: str = "double", where: str = "") -> str:
    out = ", ".join(f"cast({x} as {kind}) as {k}" for k, x in cells.items())
    return f"with px as ({source}) select pixel_id, {out} from px {where}"
