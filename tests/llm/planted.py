"""Secrets and look-alikes of forms that the field's training doesn't generate, planted in texts that it didn't see."""

import random

from emtally.llm import secrets

_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _run(rng, chars, n):
    return "".join(rng.choice(chars) for _ in range(n))


def secret(rng) -> tuple[str, str]:
    """(text, the secret in it)."""
    every = _LOW + _UP + _DIG
    forms = (
        ("{}", f"xoxb-{_run(rng, _DIG, 11)}-{_run(rng, _DIG, 12)}-{_run(rng, every, 24)}"), ("GOOGLE_KEY={}", "AIza" + _run(rng, every + "-_", 35)), ("{}", "github_pat_" + _run(rng, every, 22) + "_" + _run(rng, every, 40)),
        ("npm login with {} please", "npm_" + _run(rng, every, 36)), ("aws_secret_access_key {}", _run(rng, every + "+/", 40)), ("Authorization: Basic {}", _run(rng, every, 27) + "="),
        ("postgres://admin:{}@db.internal/prod", _run(rng, every, 14)), ("passphrase: \"{}\"", _run(rng, every, 18)), ("credentials {}", "SG." + _run(rng, every, 22) + "." + _run(rng, every, 43)), ("pwd={}", _run(rng, every, 12)),
        ("deploy key {}", f"dop_v1_{_run(rng, 'abcdef' + _DIG, 64).upper()}"), ("{}", "ya29." + _run(rng, every + "-_", 60)),
    )
    form, value = rng.choice(forms)
    return form.format(value), value


def ordinary(rng) -> str:
    """Text that holds no secret."""
    d = lambda n: _run(rng, _DIG, n)
    word = lambda: _run(rng, "aeioulnrstdm", rng.randint(3, 9))
    return rng.choice((
        f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"order no. {d(3)}-{d(7)}-{d(7)}", f"{word()}@{word()}.org", f"https://{word()}.net/a/{word()}-{word()}-{d(4)}.html", f"RFC{d(4)} and ISO-{d(4)}:{d(4)}", f"the key {word()} to {word()}",
        f"a password is {word()}", f"{d(2)}/{d(2)}/{d(4)} {d(2)}h{d(2)}", f"{word().title()}{word().title()}.java", f"v{d(1)}.{d(2)}.{d(1)}-beta{d(1)}", f"{d(1)},{d(3)},{d(3)}.{d(2)} EUR", f"MK{d(3)}x {word()}",
    ))


def measure(field, texts: list[str], seed: int = 5) -> dict:
    """Shares of planted secrets that are met by a span (recall), of the added spans that meet one (precision), and of the
    planted secrets' characters that spans cover; spans of the fixed patterns count as found."""
    rng, planted, made = random.Random(seed), [], []
    for text in texts:
        words = text.split(" ")
        at = rng.randint(0, len(words))
        said, value = secret(rng) if rng.random() < 0.5 else (ordinary(rng), None)
        before = " ".join(words[:at]) + " "
        made.append(before + said + " " + " ".join(words[at:]))
        planted.append(None if value is None else (len(before) + said.index(value), len(before) + said.index(value) + len(value)))
    n = met = added = right = chars = covered = 0
    missed, wrong = [], []
    for text, place, found in zip(made, planted, secrets.spans([t.encode() for t in made], field)):
        if place:
            n += 1
            inside = [max(0, min(e, place[1]) - max(s, place[0])) for s, _, e in found]
            met += any(inside)
            chars += place[1] - place[0]
            covered += min(sum(inside), place[1] - place[0])
            if not any(inside):
                missed.append(text[max(0, place[0] - 20) : place[1]])
        for s, kind, e in found:
            if kind == "crf":
                added += 1
                right += bool(place and s < place[1] and e > place[0])
                if not (place and s < place[1] and e > place[0]):
                    wrong.append(text[max(0, s - 20) : e])
    return {"planted": n, "recall": met / n, "covered": covered / chars, "added": added, "precision": right / max(1, added), "missed": missed, "wrong": wrong}
