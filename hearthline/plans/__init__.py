"""Named queries by topic; importing this package registers them all."""

from hearthline.plans import corpus, dialogues, evaluation, graphs, ledger, objects, relational, sources, traces  # noqa: F401
