"""Production parameters of the queries and the pipeline."""

from __future__ import annotations

from ebbline.llm.mixing import TOPICS, Targets

#: Rules of op10: verdict, and host with the beginning of the path.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Shares of the tokens: no source over a tenth, more of the smaller languages, topics alike.
TARGETS = Targets(
    source={f"src{k}": 0.05 for k in range(20)},
    lang={"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    topic={f"topic{k}": 1 / TOPICS for k in range(TOPICS)},
    keep=0.6,
)
