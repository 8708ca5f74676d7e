"""Inputs and expected decisions of the golden scenarios (fixed values): scope acme / user-42 / agent, dimension 256."""

# name -> (max_items, [(body, tags, hint)], [(action, protection, reason, evicted, sensitivity)], digests of the bodies)
SCENARIOS = {
    "capacity": (
        2,
        [
            ("the release train departs on Thursdays", [], None),
            ("the incident review template lives in the engineering wiki", [], None),
            ("the finance team closes the books on the fifth working day", [], None),
            ("the office coffee machine is descaled every fortnight", [], None),
            ("the staging cluster is rebuilt from scratch every night", [], None),
        ],
        [("retain", "protected", "protected_fragile", 0, "internal"), ("retain", "normal", "novel_content", 0, "internal")] + [("retain", "normal", "novel_content", 1, "internal")] * 3,
        [
            "ddc4d35d988c21bfb6a3079b40c23d7eaff03f96aaa9453079074532d31a4ff4",
            "59d7d50002a393426e26d6edeaf20079659ceaf8a052def11bc3622b23bab272",
            "3c3c8987fb4550fc860d9901ca8a4d0d546b1076279ececbd3219e811429d03e",
            "b69f72c242d8ac4a749f6a32dff7303f5bc0fe8df938b0c0b25d9c05e8b57da8",
            "8933a95d9f08f407b71fef04cb1b11ac77fc6667c6ae52e9babef7e73633b140",
        ],
    ),
    "novelty": (
        None,
        [
            ("the production database migration runs on Sundays at 02:00 UTC", ["ops"], None),
            ("the on-call rotation starts Monday morning and hands over on Friday", ["ops"], None),
            ("the customer prefers written summaries over meetings", ["style"], None),
        ],
        [("retain", "protected", "protected_fragile", 0, "internal"), ("retain", "normal", "novel_content", 0, "internal"), ("retain", "normal", "novel_content", 0, "internal")],
        ["3a5b96028ed2e887788a5fc93968718291c946b9581fd1d8c118d3778c6142aa", "136f15acbb469cc408d54400445ce13a3aacc78ea896531f7c52e9f49af61b75", "731c5292a296397a07481d39e9f286152061f6b3dcaa09c752711ae063a637f7"],
    ),
    "redundancy": (
        None,
        [("the deploy key rotates every ninety days", [], None), ("the deploy key rotates every ninety days", [], None), ("the deploy key rotates every ninety days, per the security policy", [], None)],
        [("retain", "protected", "protected_fragile", 0, "internal"), ("reject", None, "near_duplicate", 0, None), ("retain", "normal", "novel_content", 0, "internal")],
        ["6a871b982f8ba7f366c63848f2d7d332ef6972c95bcc4f54da89cda861f9bde1"] * 2 + ["bf8e55f47a7a0e8adf2f12e3e49c51ff166b2e6fab38e0d2eb4e4e06cd15846f"],
    ),
    "sensitivity": (
        None,
        [("the deployment api key is sk-abc123def456ghi789jkl012mno345", [], "public")],
        [("retain", "protected", "sensitivity_conflict", 0, "restricted")],
        ["f1af197e6e03235629b3b0b4d492e017d7efb3dcedf1636aeef88b1db76da321"],
    ),
}
