"""python -m kindred block|train|infer"""

from kindred.plans.linkage import main

main()
