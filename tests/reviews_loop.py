"""The loop over reviews, as the rule is written: match, merge, save, next."""

import hashlib

FIELDS = {"partner": (2, False), "announced_at": (5, False), "title": (3, True), "status": (4, True)}


def fold(text):
    return (text or "").strip().lower()


def loop_reviews(campaigns, of_campaigns, reviews, of_reviews, now):
    """({review: campaign}, {campaign: (partner, title, status, announced_at)}, {(campaign, source)})."""
    state = {c[0]: {"ip": c[1], "seen": c[6], "updated": c[7], "dead": c[9] is not None, **{f: c[i] for f, (i, _) in FIELDS.items()}} for c in campaigns}
    cites, held, went = {}, {}, {}
    for c in state.values():
        c["partner"] = c["partner"] if fold(c["partner"]) else None
    for r, s, *_ in of_reviews:
        cites.setdefault(r, set()).add(s)
    for c, s, *_ in of_campaigns:
        held.setdefault(c, set()).add(s)
    for r in sorted(reviews):
        name, wanted, ip = r[0], r[1], r[2]
        mine = {"ip": ip, "seen": r[7], "updated": r[8], "dead": False, **{f: r[i + 1] for f, (i, _) in FIELDS.items()}}
        p, fits = fold(mine["partner"]), []
        mine["partner"] = mine["partner"] if p else None
        for key, c in state.items():
            q = fold(c["partner"])
            if c["dead"] or c["ip"] != ip or (p and q and p != q):
                continue
            if key == wanted or held.get(key, set()) & cites.get(name, set()) or (q and p == q):
                fits.append((c["seen"], key))
        if not fits:
            key = wanted
            if wanted is None or wanted in state:
                key = "campaign-" + hashlib.sha256(":".join(x for x in (wanted, name) if x is not None).encode()).hexdigest()[:24]
            state[key], held[key] = mine, set(cites.get(name, ()))
        else:
            key = min(fits)[1]
            c, changed = state[key], bool(cites.get(name, set()) - held.get(key, set()))
            newer = mine["updated"] > c["updated"]
            held.setdefault(key, set()).update(cites.get(name, ()))
            for f, (_, newer_only) in FIELDS.items():
                if mine[f] is None or mine[f] == c[f] or (newer_only and not newer):
                    continue
                if c[f] is None or newer:
                    c[f], changed = mine[f], True
            if changed:
                c["updated"] = max(c["updated"], now)
        went[name] = key
    return went, {k: (c["partner"], c["title"], c["status"], c["announced_at"]) for k, c in state.items()}, {(k, s) for k, v in held.items() for s in v}
