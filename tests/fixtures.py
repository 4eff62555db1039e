"""Hand-made mini projects and mappings shared by the tests."""

#: A planner and a motor that import each other, a shared type, and a file that nothing imports.
JAVA_FILES = {
    "org/polaris/dome/ShutterPlanner.java": (
        "package org.polaris.dome;\n\nimport java.time.Instant;\nimport org.polaris.sky.Window;\nimport org.polaris2.Meteo;\n"
        "import org.polaris.dome.ShutterMotor;\n\n"
        "/**\n * Opens the dome at dusk.\n * @since 3.1\n */\npublic final class ShutterPlanner {\n"
        '    private static final String BUS = "bus.org.polaris.shutters";\n'
        "    private final ShutterMotor shutterMotor;\n    /* Shuttering is another word */\n"
        "    boolean mayOpen(Window window, Instant at) {\n"
        '        log.warn("asked at {}", at);\n'
        "        return window.holds(at) && shutterMotor.idle(); // no rain check yet\n    }\n}\n"
    ),
    "org/polaris/dome/ShutterMotor.java": (
        "package org.polaris.dome;\n\nimport org.polaris.sky.Window;\nimport org.polaris.dome.ShutterPlanner;\n\n"
        'class ShutterMotor {\n    int SHUTTER_SPEED = 4;\n    String brand = "slow shutter";\n'
        "    boolean idle() { return SHUTTER_SPEED == 0; }\n}\n"
    ),
    "org/polaris/sky/Window.java": (
        "package org.polaris.sky;\n\nimport org.polaris.sky.Arc;\n\n"
        "public record Window(Arc rise, Arc fall) {}\n"
    ),
    "org/polaris/sky/Arc.java": "package org.polaris.sky;\n\npublic record Arc(double degrees) {}\n",
    "org/polaris/lab/Bench.java": "package org.polaris.lab;\n\nimport org.polaris.sky.Arc;\n\nclass Bench {}\n",
}
JAVA_MAPPING = [("package", 0, "org.polaris", "net.sample"), ("variable", 0, "Shutter", "Gate")]
JAVA_ENTRY = "org/polaris/dome/ShutterPlanner.java"
JAVA_REACHED = ["org.polaris.dome.ShutterPlanner", "org.polaris.sky.Window", "org.polaris.dome.ShutterMotor", "org.polaris.sky.Arc"]

#: A board whose row imports it back, a chain of store files, and a module that does not exist.
REACT_FILES = {
    "screens/orchard/OrchardBoard.tsx": (
        "import React from 'react';\nimport { now } from '@/lib/clock';\nimport { useOrchard } from './useOrchard';\n"
        "import { Row } from './Row';\nimport { rain } from './weather';\n\n"
        "export const OrchardBoard = () => {\n  const { orchards } = useOrchard(); // all of them\n"
        "  const heading = \"Orchard by the river\";\n  const foot = `no trees`;\n"
        "  const line = `${orchards.length} at ${now()}`;\n  console.warn('board', heading);\n"
        "  return <section title={heading}>{/* rows */}<Row text={line} /></section>;\n};\n"
    ),
    "screens/orchard/useOrchard.ts": (
        "import { now } from '../../lib/clock';\nimport { read } from '@/store';\n\n"
        "export const useOrchard = () => ({ orchards: read('ripe orchard'), at: now() });\n"
    ),
    "screens/orchard/Row.jsx": (
        "import { OrchardBoard } from './OrchardBoard';\n\nexport const Row = ({ text }) => <p>{text}</p>;\n"
    ),
    "lib/clock.ts": "export const now = () => Date.now();\n",
    "store/index.ts": "import { slice } from './orchardSlice';\n\nexport const read = (key: string) => slice[key];\n",
    "store/orchardSlice.ts": "export const slice: Record<string, string[]> = { ORCHARD_KEY: ['north', 'south'] };\n",
}
REACT_MAPPING = [("package", 0, "screens/orchard", "screens/area1"), ("variable", 0, "Orchard", "Plot")]
REACT_ENTRY = "screens/orchard/OrchardBoard.tsx"
REACT_REACHED = [
    REACT_ENTRY, "screens/orchard/weather", "lib/clock.ts", "screens/orchard/useOrchard.ts", "screens/orchard/Row.jsx",
    "store/index.ts", "store/orchardSlice.ts",
]


def mappings_df(spark, pairs, set_id="s"):
    rows = [(set_id, kind, n, frm, to) for kind, n, frm, to in pairs]
    return spark.createDataFrame(rows, "set_id string, kind string, ord int, `from` string, `to` string")


def variables(*pairs):
    return [("variable", n, frm, to) for n, (frm, to) in enumerate(pairs)]


def files_df(spark, files, lang, project="p"):
    rows = [(project, path, lang, text) for path, text in files.items()]
    return spark.createDataFrame(rows, "project string, path string, lang string, text string")
