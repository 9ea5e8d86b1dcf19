import sys

from stratafold.cli import main

sys.exit(main())
