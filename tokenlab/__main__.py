"""python -m tokenlab: see plans.runs."""

from .plans.runs import main

main()
