import sys

from tabmend.cli import main

sys.exit(main())
