"""Query plans: the plan type, its checks, its builders and the engine that answers them."""
