"""Sources: test tables, the derived spec-sheet fixture, CSV spec sheets."""
