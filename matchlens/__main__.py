from matchlens.cli import run

raise SystemExit(run())
