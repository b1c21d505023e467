"""Text for people: one recording's small tables, rendered on the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracepath.functions.columns import SEPARATOR
from tracepath.plans.analyse import Analysis


def micros(n: int) -> str:
    return f"{n / 1000:.1f}ms" if abs(n) >= 1000 else f"{n}us"


def size(n: int) -> str:
    for unit, step in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= step:
            return f"{n / step:.1f}{unit}"
    return f"{n}B"


def described(subject: str | None) -> str:
    return f" ({subject.replace(SEPARATOR, ', ')})" if subject else ""


def sentence(f) -> str:
    what = f"{f['name']}{described(f['subject'])}"
    return {
        "repeated work": f"{what} ran {f['count']} times on the chain; all but the first cost {micros(f['cost'])}",
        "dead wait": f"nothing ran for {micros(f['cost'])} before {what}" + ("" if f["stated"] else ", and nothing says what it waited for"),
        "off-path dominance": f"{what} is the largest work, {micros(f['evidence'])}, and off the chain, with {micros(f['room'] or 0)} of room",
        "in flight while waiting": f"{what} was in flight during {f['count']} waits, {micros(f['evidence'])} of them",
    }[f["rule"]]


def report(analysis: Analysis, trace_id: str, budget: int = 5, most: int = 200) -> str:
    """What there is to say about one recording. At most ``most`` steps and findings are printed, with a count of the rest."""

    def rows(df, *order):
        return df.where(F.col("trace_id") == trace_id).orderBy(*order).limit(most + 1).collect()

    if refused := rows(analysis.refusals, "because"):
        named = f"; origins named: {refused[0]['suggestions']}" if refused[0]["suggestions"] else ""
        return f"{trace_id}\nrefused: {refused[0]['because']}{named}\n"
    (s,) = rows(analysis.summary, "steps")
    names = analysis.recording.activities.select("trace_id", "activity_id", "name", "subject")
    out = [trace_id, f"finish decided by {s['steps']} steps: {micros(s['work'])} of work, {micros(s['wait'])} of waiting; margin {'unbounded' if s['margin'] is None else micros(s['margin'])}"]
    for step in rows(analysis.steps.join(names, ["trace_id", "activity_id"]), "step")[:most]:
        out.append(f"  {'+' + micros(step['wait_before']) + ' ' if step['wait_before'] else ''}{step['name']}{described(step['subject'])} {micros(step['end'] - step['start'])}")
    for title, table in (("findings", analysis.findings), ("withheld", analysis.withheld), ("unattributed", analysis.unattributed)):
        found = rows(analysis.placed(table) if analysis.isolation else table, "place")
        if found:
            out.append(f"{title}:")
        for f in found[:most]:
            out.append(f"  {sentence(f)}")
            if analysis.isolation and f["source"]:
                out.append(f"    in {f['source']}:{f['line']}{f', {f['depth']} calls out' if f['depth'] else ''}{'' if f['proved'] else ', by the map only'}{f': {f['text'].strip()}' if f['text'] else ''}")
    for p in rows(analysis.repair(budget), "recovered"):
        told = f"recovers {micros(p['recovered'])}" + (f", trust {p['trust']:.2f}" if p["trust"] is not None else "") if p["because"] is None else p["because"]
        out.append(f"repair {', '.join(map(str, p['chosen'] or [])) or 'nothing'}: {told}" + (f"; {p['unweighable']} costs can't be weighed" if p["unweighable"] else ""))
    out += [f"silent: {x['rule']}: {x['because']}" for x in rows(analysis.silences, "rule")]
    if analysis.responses is not None:
        for r in rows(analysis.responses, "place")[:most]:
            out.append(f"{r['kind']}: {micros(r['elapsed'])}{'' if r['exact'] else ' at least'}, {micros(r['working'])} working, {micros(r['waiting'])} waiting")
    if analysis.isolation:
        for p in rows(analysis.isolation.places, F.desc("cost"), "source", "line")[:most]:
            out.append(f"{micros(p['cost'])} in {p['source']}:{p['line']}, {p['calls']} calls{'' if p['proved'] else ', by the map only'}{f', of {p['package']}' if p['package'] else ''}")
        for n in rows(analysis.isolation.counts, "stated"):
            out.append(f"places: {n['stated']} stated, {n['placed']} found, {n['confirmed']} confirmed; maps agree with {n['agreements']} and disagree with {n['disagreements']}")
    (c,) = rows(analysis.recording.coverage, "unread")
    out.append("coverage: " + ", ".join(f"{k} {c[k]}" for k in ("unread", "unpaired", "unbound_flows", "contradicted", "censored")))
    return "\n".join(out) + "\n"
