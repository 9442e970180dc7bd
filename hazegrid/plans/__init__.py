"""Multi-step jobs: training, evaluation, model choice, scoring."""
