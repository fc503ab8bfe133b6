"""A small source tree for tests."""

#: A tree of Python and TypeScript with nested scopes, relative imports, aliases and re-exports.
SOURCES = {
    "pkg/__init__.py": '"""The package."""\nfrom .core import Runner\n__all__ = ["Runner"]\n',
    "pkg/core.py": 'from . import util\nfrom .util import helper as run_helper\n\n\nclass Base:\n    pass\n\n\nclass Runner(Base):\n    """Runs things."""\n\n    def run(self, value: int = 1) -> int:\n        """Run once."""\n        def inner(x):\n            return run_helper(x)\n        return inner(value)\n\n    def stop(self):\n        return self.run(0)\n',
    "pkg/util.py": "LEFT, (RIGHT, _) = 1, (2, 3)\n\n\ndef helper(x):\n    for i in range(x):\n        if i in [1, 2]:\n            x += i\n    return x\n\n\ndef other():\n    return helper(3)\n",
    "pkg/broken.py": "def lost(:\n    pass\nimport pkg.util\n",
    "main.py": "import pkg.core\nfrom pkg import util\nfrom pkg.core import Runner\n\nif __name__ == '__main__':\n    Runner().run(2)\n",
    "web/index.ts": "export * from './shapes';\nexport { area as size } from './area.js';\nexport const version = '1';\n",
    "web/shapes.ts": "import { area } from './area';\n/** A square. */\nexport class Square extends Shape {\n  side() {\n    return area(2, 2);\n  }\n}\nexport interface Options { on: boolean }\n",
    "web/area.ts": "// Multiplies.\nexport const area = (a: number, b: number) => multiply(a, b);\nfunction multiply(a: number, b: number) {\n  return a * b;\n}\n",
    "README.md": "# Title\n\nProse.\n\n## Install\n\nnpm\n",
}
