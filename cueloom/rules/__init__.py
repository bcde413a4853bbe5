"""Quality rules over cues.

A rule is a set of columns over a cue and its neighbours, so all rules of a run share one window and
one scan: each row gives an array of issues, which is exploded.
"""

from cueloom.rules import cue_rules  # noqa: E402, F401  (fills the registry)
